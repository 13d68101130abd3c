"""The search index against a scan in plain Python; folding, places and paragraphs of odd texts."""

import random
import re
import time
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pliego.functions import text
from pliego.operators import search, textindex
from pliego.plans import oracle_sql, queries


def fold(t):
    """Unit by unit, as the rule is stated."""
    return "".join("".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.category(x).startswith("M")).lower() if ord(c) < 0x10000 else c for c in t)


def rows():
    rng = random.Random(3)
    parts = ["ña", "Cá", "lcu", "lo", "x", "日本", "가각", "が", "straße", "é", "of", "the", "q"]
    make = lambda n: " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(n))
    return [None, "", " \n ", "x", "ab", "y" * 50_000 + "z", "a  b", *(make(rng.randrange(1, 40)) for _ in range(150))]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index"))
    docs = spark.createDataFrame([(i, t, "clash", "r") for i, t in enumerate(rows())], "id long, text string, gram string, row string")
    textindex.write_segment(docs.where("id % 3 = 0").repartition(3), root)
    textindex.write_segment(docs.where("id % 3 <> 0").repartition(2), root)
    textindex.write_segment(docs.where("id < 0"), root)
    return root


@pytest.mark.parametrize("query", ["CALCULO", "x", "q x", "of the", "ñaCá", "가", "ᄀ", "가가", "か", "日本 straße", "lolo", "yyyyyyyz", "zz", "ab", "b a", "lo q x", "nothing", "x nothing", "", " "])
def test_index_finds_what_a_scan_finds(spark, indexed, query):
    words = fold(query).split()
    want = sorted(i for i, t in enumerate(rows()) if t and words and all(w in fold(t) for w in words))
    found = textindex.find(spark, indexed, query)
    assert sorted(r.id for r in found.collect()) == want
    assert found.columns == ["id", "text", "gram", "row", "hit"]


def test_rarest_postings_are_read_and_blocks_pruned(spark, indexed):
    plans = {s: textindex.plan(spark, indexed, s, "yyyyyyyz x") for s in textindex.segments(spark, indexed)}
    ((segment, planned),) = ((s, p) for s, p in plans.items() if all(n for _, n, _ in p))  # one of them has the long word
    chosen = [x for x, _, read in planned if read]
    assert ("yyz", False) in [x for x, _, _ in planned] and all(n >= 0 for _, n, _ in planned)
    assert chosen and max(n for x, n, read in planned if read) <= min((n for x, n, read in planned if not read), default=10**9)
    lists = spark.read.parquet(f"{indexed}/{segment}/postings")
    read = lists.where(F.col("gram") == "yyz")
    explained = lambda df: df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [IsNotNull(gram), EqualTo(gram,yyz)]" in explained(read)
    assert re.search(r"PartitionFilters: \[[^\]]*block", explained(textindex.find(spark, indexed, "yyyyyyyz")))


def test_unfinished_segments_count_for_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two")], "id long, text string")
    textindex.write_segment(docs, str(tmp_path))
    (tmp_path / "sbroken" / "texts").mkdir(parents=True)
    assert textindex.find(spark, str(tmp_path), "two").count() == 1
    with pytest.raises(FileNotFoundError):
        textindex.find(spark, str(tmp_path / "none"), "x")


def test_first_hits_by_index(spark, tmp_path):
    pages = spark.createDataFrame([("d", 1, "uno"), ("d", 2, "dos uno"), ("d", 3, "uno dos"), ("e", 1, "tres")], "doc string, n_page int, text string")
    textindex.write_segment(pages, str(tmp_path))
    assert [tuple(r) for r in textindex.first_hits(spark, str(tmp_path), "doc", "DÓS uno").collect()] == [("d", 2, "dos uno", 1)]


def test_global_search_by_index(spark, tmp_path):
    docs = spark.createDataFrame([("d", "Uno dos", 5, "f", None, ["p1", "gone", "p2", "p1"]), ("e", "Tres", 6, None, None, ["p3"]), ("t", "Uno", 7, None, 1, ["p4"])], "id string, nombre string, modificado long, carpeta_id string, papelera long, paginas array<string>")
    pages = spark.createDataFrame([("p1", "uno ñandú"), ("p2", "dos uno"), ("p3", None), ("p4", "uno dos")], "id string, texto string")
    folders = spark.createDataFrame([("f", "Carpeta")], "id string, nombre string")
    textindex.write_segment(pages.select(F.col("id").alias("page_id"), F.col("texto").alias("text")), str(tmp_path))
    for query in ["UNO", "dos uno", "nandu", "tres", "carpeta", "x", ""]:
        scanned, found = (search.search(docs, pages, folders, query, root).collect() for root in (None, str(tmp_path)))
        assert scanned == found, query
    assert len(search.search(docs, pages, folders, "uno", str(tmp_path)).collect()) == 1


def test_every_character_folds_by_itself(spark):
    texts = ["".join(map(chr, range(a, min(a + 4096, 0x10000)))) for a in range(0, 0x10000, 4096)]
    texts = [re.sub("[\ud800-\udfff]", "", t) for t in texts] + ["ΟΔΟΣ İ ß", "𐐀 𝅥", "각́ 힣"]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", text.fold(F.col("t")).alias("f")).collect()
    for r in got:
        assert r.f == fold(texts[r.k]) == text.fold_here(texts[r.k])


def test_places_are_those_of_the_text(spark):
    t = "́각 ñandú 가 ȩ̈x"
    for query in ["a", "n", "du", "x", "각", "ᆨ", "가", "e"]:
        word = text.terms_here(query)[0]
        origin = [i for i, c in enumerate(t) for _ in fold(c)]
        at = fold(t).find(word)
        h = spark.range(1).select(text.hit(F.lit(t), [word]).alias("h")).first().h
        assert (h.start, h.end) == (origin[at], origin[at + len(word) - 1] + 1), query


@pytest.mark.parametrize("t", ["𝅥the", "𐐀𝅥 é가각 the", "́̈각́각́ 가the", "thé" * 3 + "x" * 50])
def test_places_behind_marks_and_syllables(spark, t):
    origin = [i for i, c in enumerate(t) for _ in fold(c)]
    at = fold(t).find("the")
    h = spark.range(1).select(text.hit(F.lit(t), ["the"]).alias("h")).first().h
    assert (h.start, h.end) == (origin[at], origin[at + 2] + 1)


def paragraphs_by_lines(t):
    """The rule line by line."""
    white = " \t\n\x0b\x0c\r\xa0     　﻿" + "".join(map(chr, range(0x2000, 0x200B)))
    entry = re.compile(r"(\(?[0-9]{1,3}[.)°º-]|\(?[a-zñ][.)]|[•·▪◦\-–—])[\t\x0b\x0c\r ]", re.I)
    out = []
    for block in re.split(r"\n[ \t\n\x0b\x0c\r]*\n", t):
        lines = [x for x in (line.strip(white) for line in block.split("\n")) if x]
        for k, line in enumerate(lines):
            if k == 0 or entry.match(line):
                out.append(line)
            elif re.search(r"[^\W\d_][-‐]$", out[-1]) and line[0].islower():
                out[-1] = out[-1][:-1] + line
            else:
                out[-1] += " " + line
    return out


def test_paragraphs_of_odd_texts(spark):
    rng = random.Random(6)
    pieces = ["\n", "\n\n", " ", "\t", "　", "\xa0", "one", "su-", "jetos", "1) ", "a. ", "- ", "• x", "Ñ) ", "￿", "\r\n", "ABC", "99. "]
    texts = ["", " ", "one￿ two", *("".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(400))]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", text.paragraphs(F.col("t")).alias("p")).collect()
    for r in got:
        assert r.p == paragraphs_by_lines(texts[r.k]), texts[r.k]


@pytest.mark.parametrize("make", [lambda n: "x" + " " * n + "y", lambda n: "x" + "\n " * (n // 2) + "y", lambda n: " " * n, lambda n: "x\n" + " " * n + "y" + "　" * n])
def test_long_runs_of_white_space(spark, make):
    df = spark.createDataFrame([(make(1_000_000),)], "t string").cache()
    df.count()
    began = time.time()
    df.select(F.size(text.paragraphs(F.col("t"))), text.file_name(F.col("t"), "pdf")).collect()
    assert time.time() - began < 15


def test_index_queries_have_sql():
    assert {"search_by_index", "index_postings", "fold_scripts"} <= set(queries()) & set(oracle_sql())


def grams_by_words(t):
    return {(w + "  ")[k : k + 3] for w in re.split("[ \t\n\x0b\x0c\r\xa0  -     　﻿]+", fold(t)) for k in range(len(w))}


@pytest.mark.parametrize("texts", [[""], [" ", "a"], [t for t in rows() if t], ["".join(map(chr, range(a, a + 1000))) for a in (1, 0x600, 0xAC00, 0xFE00, 0x1D100)], ["".join(map(chr, range(0x20000, 0x50000))), *(f"a b{k}" for k in range(1300))]])
def test_grams_of_many_texts_at_once(texts):
    names, which, of = textindex.grams(texts)
    assert [(int(a), int(b)) for a, b in zip(which, of)] == sorted({(int(a), int(b)) for a, b in zip(which, of)}) and len(set(names)) == len(names)
    found = [set() for _ in texts]
    for a, b in zip(which, of):
        found[b].add(names[a])
    assert found == [grams_by_words(t) for t in texts]


def test_lists_leave_tasks_not_pairs(spark, tmp_path, monkeypatch):
    """A gram that many texts have is a list before it is shuffled; texts taken apart in turns are joined again."""
    docs = spark.createDataFrame([(k, f"the {k}") for k in range(300)] + [(300, None)], "id long, text string").coalesce(1)
    name = textindex.write_segment(docs, str(tmp_path))
    (got,) = spark.read.parquet(f"{tmp_path}/{name}/postings").where("gram = 'the'").collect()
    assert list(got.rows) == list(range(300)) and got.size == 300
    batch = pa.RecordBatch.from_pydict({"block": [0] * 200 + [7] * 100, "row": pa.array([*range(200), *range(100)], pa.int32()), "text": [b"the"] * 299 + [None]})
    for most in (1 << 22, 400):
        monkeypatch.setattr(textindex, "AT_ONCE", most)
        sent = [(block, rows) for b in textindex._lists([batch]) for g, block, rows in zip(b["gram"].to_pylist(), b["block"].to_pylist(), b["rows"].to_pylist()) if g == "the"]
        assert [(b, r) for b, rows in sent for r in rows] == [*((0, r) for r in range(200)), *((7, r) for r in range(99))] and len(sent) == (2 if most > 400 else 4)

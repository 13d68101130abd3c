"""Periodic runs, aligned tokenizers and licences against brute force, with nulls, empty and very long texts, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pliego.llm import alignment, licenses, periodic, quality, registry, suffixes, toxicity

SCHEMA = "doc_id long, text string, words string, runs int, row long, template int, stripe string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    None, "", " ", "\n\t ", "one", "a a a a a", "a a a a a a", "ab ab ab ab ab ab ab", "x y x y x y x y z", "la la la la la la, la la", "tab\tand\nline\n\n", " two  spaces ", "<|endoftext|> and <s> </s> <0x41>", "a▁b is a piece's space",
    "日本語 のテキスト 日本語", "é́ ñ ß İ  x y", "\x1c a\x85 b", "emoji 👩‍👩‍👧 here", "CC BY cc-by Cc\nby 4.0", "ALL rights RESERVED. all-rights-reserved", "the GNU General Public License, version 3.",
    "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "This is licensed, broadly, under the well known MIT license of old",
    "Permission is hereby granted, free of any charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without any restriction",
]


def made():
    rng = random.Random(4)
    vocabulary = ["the", "of", "ñandú", "over", "cc", "by", "all", "rights", "reserved", "general", "public", "license", "under", "mit", "x1", "Straße", "don't", "(a)", "**"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    out = [*ODD, *(make(rng.randrange(1, 150)) for _ in range(60))]
    for _ in range(20):
        a, b = make(rng.randrange(1, 7)), make(rng.randrange(0, 30))
        out.append(f"{b} {' '.join([a] * rng.randrange(3, 9))} {b}")
    out.append("ha " * 40_000 + make(20_000))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "w", 1, 5, 2, "s") for i, t in enumerate(made())]
    rows += [rows[7], rows[30], (None, "la la la la la la la", "w", 1, 5, 2, "s"), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def brute_runs(w, least=6, exponent=4):
    n, out = len(w), set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            a = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i > a:
                size = i - a + q
                if size >= max(least, exponent * q) and not any(all(w[a + k] == w[a + k + r] for k in range(size - r)) for r in range(1, q)):
                    out.add((a, size, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (2, 2), (6, 2), (1, 3)])
def test_runs_of_few_letters(least, exponent):
    rng = random.Random(least + exponent)
    for _ in range(700):
        w = [rng.randint(0, rng.randint(1, 3)) for _ in range(rng.randrange(50))]
        if w and rng.random() < 0.5:
            a, p = rng.randrange(len(w)), rng.randint(1, 6)
            w = w[:a] + [w[a + k % p] if a + k % p < len(w) else 9 for k in range(len(w) - a)]
        assert periodic.runs_of(w, least, exponent) == brute_runs(w, least, exponent), w


def test_stretches_hold_every_run():
    rng = random.Random(8)
    for _ in range(500):
        w = [rng.randint(0, 30) for _ in range(rng.randrange(20, 200))]
        a, p = rng.randrange(len(w)), rng.randint(1, 9)
        w = w[:a] + [w[a + k % p] for k in range(len(w) - a)] + [rng.randint(0, 30) for _ in range(30)] if a + p < len(w) else w
        parts = periodic.stretches(periodic.np.array(w), 6, 4)
        assert all(any(x <= s and s + size <= y for x, y in parts) for s, size, _ in brute_runs(w))


@pytest.mark.parametrize("words", [["a"] * 200_000, ["lol", "ha"] * 100_000, [random.Random(1).randint(0, 10**6) for _ in range(700)] * 300])
def test_long_runs_are_one(words):
    (run,) = periodic.runs_of(words)
    assert run[:2] == (0, len(words)) and run[2] in (1, 2, 700)


def brute_op11(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = periodic.runs_of(w) if n > 5000 else brute_runs(w)
    gone = {k for s, size, q in runs for k in range(s + q, s + size)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return doc_id, len(runs), *best, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))


def test_op11(spark, docs, empty, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.op11_periodic_runs(spark, str(tmp_path))
    want = sorted((brute_op11(r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert rows(got) == want and sum(r[1] > 0 for r in want) > 20
    assert rows(periodic.digests(periodic.periodic_runs(empty))) == []


def test_runs_and_texts_of_the_operator(spark):
    found = periodic.periodic_runs(spark.createDataFrame([(1, "so ha ha ha ha ha ha no"), (None, None)], "doc_id long, text string")).collect()
    assert [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in found] == [(1, [(1, 6, 1)], "so ha no"), (None, [], "")]


def brute_alignment(texts):
    """Figures by texts tokenized whole."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(registry.tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=registry.tokenizer_path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbol = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    out, links = [], []
    for t in texts:
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        bytes_a, bytes_b = [bytes(symbol[c] for c in a.id_to_token(i)) for i in ids_a], [piece(i) for i in ids_b]
        if not t or not (b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode()):
            out.append(None)
            links.append([])
            continue
        ends = []
        for parts in (bytes_a, bytes_b):
            at, e = 0, []
            for p in parts:
                at += len(p)
                e.append(at)
            ends.append(e)
        shared = sorted(set(ends[0]) & set(ends[1]))
        own, groups, low = [], [], 0
        for s in shared:
            x = [i for i, e in zip(ids_a, ends[0], strict=True) if low < e <= s]
            y = [i for i, e in zip(ids_b, ends[1], strict=True) if low < e <= s]
            own.append((x[-1], y[-1]))
            groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
            low = s
        out.append((len(ids_a), len(ids_b), len(shared), len(shared), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(own)
    counts = Counter(x for own in links for x in own)
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(*(f or (0, 0, 0, 0, None)), sum(counts[x] == best[x[1]] for x in own), sum(counts[x] for x in own)) for f, own in zip(out, links, strict=True)]


@pytest.mark.parametrize(("stripes", "chunk", "group"), [(64, 4 << 20, 256), (7, 500, 2)])
def test_alignment(spark, docs, empty, stripes, chunk, group):
    small = docs.where(F.coalesce(F.length("text"), F.lit(0)) < 20_000)
    source = small.collect()
    a, b = registry.tokenizer_path("byte_bpe_50k.json"), registry.tokenizer_path("piece_bpe_32k.model")
    got = alignment.align(spark.createDataFrame(source, SCHEMA), a, b, stripes, chunk, group)
    want = [(r.doc_id, *x) for r, x in zip(source, brute_alignment([r.text for r in source]), strict=True)]
    assert rows(got) == sorted(want, key=repr)
    assert rows(alignment.align(empty, a, b)) == []


def test_segments_align_as_whole_texts(spark):
    aligner = alignment.SegmentAligner(registry.tokenizer_path("byte_bpe_50k.json"), registry.tokenizer_path("piece_bpe_32k.model"), max_entries=40)
    texts = [t for t in made() if t and len(t) < 5000] + ["y" * 3000, "ab " * 50, "no space"]
    whole = brute_alignment(texts)
    for _ in range(2):
        for t, want in zip(texts, whole, strict=True):
            (got,) = aligner.align([t])
            assert (got and (got[0], got[1], got[2])) == (want[4] is not None and want[:3]), t
            assert not got or hashlib.sha256(got[4].encode()).hexdigest() == want[4]


def test_op12_writes_no_digest_without_tokens(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, "a▁b"), (3, "a b")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_a, r.groups_sha256 == "") for r in registry.op12_striped_alignment(spark, str(tmp_path)).collect()}
    assert got == {1: (0, True), 2: (0, True), 3: (2, False)}


def test_squeezed_numbers():
    rng = random.Random(2)
    for top in (0, 1, 255, 256, 1 << 40):
        x = periodic.np.array([rng.randint(0, top) for _ in range(rng.randrange(50))], "int64")
        assert alignment.unsqueezed(alignment.squeezed(x)).tolist() == x.tolist()


BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def license_words(text):
    return [w for w in BETWEEN.split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]


def brute_licenses(text, k=3, least=0.6):
    w = license_words(text)
    starts, base = [], set()
    for p, label in licenses.PHRASES.items():
        q = p.split()
        at = [i for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q]
        starts += at
        base |= {label} if at else set()
    labels, best = set(base), 0.0
    for label, t in licenses.TEMPLATES:
        t = license_words(t)
        grams = defaultdict(list)
        for i in range(len(t) - k + 1):
            grams[tuple(t[i : i + k])].append(i)
        hits = sorted((p - i, p, i) for p in range(len(w) - k + 1) for i in grams.get(tuple(w[p : p + k]), ()))
        bands = []
        for d, p, i in hits:
            if bands and d - bands[-1][-1][0] <= max(1, len(t) // 5):
                bands[-1].append((d, p, i))
            else:
                bands.append([(d, p, i)])
        for band in bands:
            low, high = min(p for _, p, _ in band), max(p for _, p, _ in band)
            score = len({i for _, _, i in band}) / max(len(t) - k + 1, high - low + 1)
            if score >= least:
                labels.add(label)
                best = max(best, score)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else best


def test_op13(spark, docs, empty, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.op13_license_diagonals(spark, str(tmp_path))
    want = sorted(((r.doc_id, *brute_licenses(r.text)) for r in docs.collect()), key=repr)
    assert rows(got) == want
    assert {"mit", "apache-2.0", "gpl", "cc-by,cc-by-nc"} <= {r[6] for r in want}
    assert rows(licenses.labels(empty)) == []


def test_changed_notices_are_found_and_prose_is_not(spark):
    mit = dict(enumerate(t for label, t in licenses.TEMPLATES))[2].split()
    changed = " ".join(w for k, w in enumerate(mit) if k % 11 != 5)
    texts = [changed, changed.replace("hereby", "herewith"), "permission of any person to use the software is a matter of the license", "under the license of the public, all the rights"]
    found = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    spans = {r.doc_id: [(s.label, s.template, s.start) for s in r.spans] for r in found}
    assert spans[0] == [("mit", 2, 0)] and spans[1] and not spans[2] and not spans[3]


def test_templates_must_have_words():
    with pytest.raises(ValueError):
        licenses.template_grams(None, (("x", "two words"),), 3)
    with pytest.raises(ValueError):
        licenses.template_grams(None, (("x", "a few words more"),), 3, most=2)


def test_toxicity_sample_has_one_row_of_an_id_on_many(spark):
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    ids = [i for i in range(60) if not held(i)]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids] + [(ids[0], f"copy {k}") for k in range(900)] + [(ids[1], None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, toxic int")
    got = toxicity.labelled_sample(docs, labels, 20).collect()
    assert len(got) == 2 * 20 and sum((r.text or "").startswith("copy") for r in got) <= 1
    assert got and sorted(map(repr, got)) == sorted(map(repr, toxicity.labelled_sample(docs.repartition(7), labels, 20).collect()))
    assert toxicity.labelled_sample(docs.where("false"), labels, 20).count() == 0


@pytest.mark.parametrize("letters", ["a", "lol", '"', "ha"])
def test_runs_of_triggers_are_few_phrases(letters):
    import tracemalloc

    np = periodic.np
    body = (letters * 600_000)[:600_000].encode() * 2
    offsets, ids = np.array([0, 600_000, 1_200_000]), np.array([4, 9])
    tracemalloc.start()
    t = suffixes.all_triggers(body, offsets, 50, 18)
    p = suffixes.Phrases(t, body, ids, 50, 18, 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(p.rows) < 500 and peak < 250 << 20
    gone = suffixes.removed_spans(t, p, suffixes.earlier(suffixes.lowest_keys(p.rows, p.least, 50, 18), p.least), ids, len(body), 50)
    assert gone[:600_000].sum() == 0 and gone[600_000:].all()


def test_repeats_of_long_runs(spark):
    docs = spark.createDataFrame([(1, "a" * 400_000), (2, "b " + "a" * 300_000), (3, "lol" * 100_000), (4, "x" + "lol" * 50_000 + "y")], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.remove_repeats(docs).collect()}
    assert got == {1: (400_000, 0, 0), 2: (300_002, 300_000, 1), 3: (300_000, 0, 0), 4: (150_002, 150_000, 1)}


def test_texts_without_frequent_lines(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    foot, part = ["Contact us  at 555-0199", "", "  All   pages"], "shared line of six words here"
    rows = []
    for i in range(40):
        lines = [" ".join(word() for _ in range(12)) for _ in range(6)]
        rows.append((i, "\n".join(lines + (foot if i < 30 else []) + ([part] * 8 if i in (3, 4, 5, 6, 7) else [])), "h", 1, "clash", 3))
    rows += [rows[0], (None, None, None, None, None, None), (99, "short", "h", 1, "clash", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, row string, gone int").repartition(3)
    got = quality.cleaned(df)
    assert got.columns == df.columns
    normal = lambda x: " ".join(re.sub("[0-9]", "0", x).lower().split())
    texts = {}
    for r in rows:
        texts.setdefault(r[2], set()).add(r[1] or "")
    want = []
    for r in rows:
        text = r[1] or ""
        held = lambda x: sum(normal(x) in {normal(y) for y in t.split("\n")} for t in texts[r[2]])  # noqa: B023, E731
        frequent = [x for x in text.split("\n") if x.split() and held(x) > max(3, 0.02 * len(texts[r[2]]))]
        n = len(text.split())
        if n >= 50 and sum(len(x.split()) for x in frequent) <= 0.3 * n and not quality.repeated_words(text.split()) * 2 > n:
            left = "\n".join(x for x in text.split("\n") if x not in frequent)
            want.append((r[0], left, "h", len(left), "clash", 3))
    assert sorted(map(tuple, got.collect())) == sorted(want) and 30 < len(want) < 41 and any("Contact" in r[1] and "Contact" not in w[1] for r in rows for w in want if r[0] == w[0] and r[1])
    judged = {(r.doc_id, r.kept) for r in quality.judge(df).collect()}
    assert {w[0] for w in want} == {i for i, kept in judged if kept}
    assert quality.cleaned(df.where("false")).count() == 0

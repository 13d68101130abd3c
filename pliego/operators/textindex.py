"""An index for all-terms substring search: posting lists of folded texts' grams.

A gram is three characters of a word, from any of its characters on, filled up with spaces at the word's end. A term of three letters and more lies in a
text only if all its grams do; a shorter one, only if some gram begins with it. An index is a folder of segments, each written once, and there once its last table is:

* texts: the rows as given, with n, a number, in folders by block; a block is up to 65,536 rows that one task read;
* postings: (gram, block, size, rows), ranged and sorted by gram and block. rows are the numbers within the block in ascending order, which Parquet stores as packed deltas. A
  gram that nearly every text has is many rows, one for each block;
* grams: (gram, size), how many texts have it; the empty gram counts all texts.

A search looks its grams up in `grams`, reads the postings of the rarest, intersects them block by block, the shortest first, and verifies the texts of what
is left, reading only their blocks. Only the terms' own grams and, where they are few, blocks' numbers come to the driver.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources import shared

SIZE = 3
BLOCK_BITS = 16
#: Texts of about so many bytes are taken apart together; their grams' lists leave the task.
AT_ONCE = 4 << 20
#: Parquet's own delta coding of ascending numbers; a dictionary would come before it.
DELTAS = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "parquet.block.size": str(16 << 20)}


def grams(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(grams, which of them, text): each text's distinct grams as pairs, in order of grams and then texts. Texts are folded and taken apart together."""
    codes, of = text.fold_codes(texts)
    space = text.space_codes()[codes]
    codes[space] = ord(" ")
    letters = np.zeros(text.DROPPED, bool)
    letters[codes] = True
    letters = np.flatnonzero(letters)
    k, n = len(letters), max(1, len(texts))
    if k**3 * n >= 1 << 63:  # so many different characters that a pair is no number of 64 bits
        half = len(texts) // 2
        parts, known = [grams(texts[:half]), grams(texts[half:])], {}
        which = [np.array([known.setdefault(g, len(known)) for g in p[0]], int)[p[1]] for p in parts]
        which, rows = np.concatenate(which), np.concatenate([parts[0][2], parts[1][2] + half])
        order = np.lexsort((rows, which))
        return list(known), which[order], rows[order]
    number = np.zeros(text.DROPPED, np.int64)
    number[letters] = np.arange(k)
    blank, at = number[ord(" ")], number[codes]
    second = np.append(at[1:], blank)
    third = np.where(second == blank, blank, np.append(second[1:], blank))
    pairs = (((at * k + second) * k + third) * n + of)[~space]
    pairs.sort()
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]]
    gram, rows = np.divmod(pairs, n)
    new = np.append(True, gram[1:] != gram[:-1])[: len(gram)]
    some = gram[new]
    said = letters[np.stack([some // (k * k), some // k % k, some % k], 1)].astype("<u4").tobytes().decode("utf-32-le")
    return [said[i : i + SIZE] for i in range(0, len(said), SIZE)], np.cumsum(new) - 1, rows


def _lists(batches):
    """(gram, block, rows) of texts (block, row, text) by batches of Arrow: ascending numbers of a block's texts that stand near each other."""
    for batch in batches:
        block, row, texts = (batch.column(k) for k in range(3))
        block, row = block.to_numpy(), row.to_numpy()
        ends = pc.binary_length(texts).fill_null(0).to_numpy().cumsum(dtype=np.int64)
        for part in np.split(np.arange(len(ends)), np.flatnonzero(np.diff(ends // AT_ONCE)) + 1):
            names, which, of = grams([(t or b"").decode("utf-8", "replace") for t in texts.take(pa.array(part)).to_pylist()])
            blocks, rows = block[part][of], row[part][of]
            new = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (blocks[1:] != blocks[:-1]))[: len(which)])
            lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(which)), pa.int32()), pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(which[new])), pa.array(blocks[new], pa.int64()), lists], ["gram", "block", "rows"])


def write_segment(rows: DataFrame, root: str, column: str = "text", partitions: int | None = None) -> str:
    """Add rows (with a text column, and whatever else) to the index in root; returns the segment's name."""
    spark = rows.sparkSession
    name = f"s{uuid.uuid4().hex}"
    at = f"{root}/{name}"
    n = F.col("n")
    numbered = rows.withColumn("n", F.monotonically_increasing_id()).withColumn("block", F.shiftright(n, BLOCK_BITS))
    numbered.write.partitionBy("block").parquet(f"{at}/texts")
    if not any(x.startswith("block=") for x in shared.children(spark, f"{at}/texts")):  # of no rows, a file that has the columns
        numbered.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{at}/texts")
    shared.ship(spark)
    kept = spark.read.parquet(f"{at}/texts").select(F.col("block").cast("long").alias("block"), (n % (1 << BLOCK_BITS)).cast("int").alias("row"), F.col(column).cast("binary").alias("text"))
    lists = kept.mapInArrow(_lists, "gram string, block long, rows array<int>").groupBy("gram", "block").agg(F.sort_array(F.flatten(F.collect_list("rows"))).alias("rows"))
    lists = lists.select("gram", "block", F.size("rows").alias("size"), "rows")
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists.repartitionByRange(p, "gram", "block").sortWithinPartitions("gram", "block").write.options(**DELTAS).parquet(f"{at}/postings")
    sizes = spark.read.parquet(f"{at}/postings").groupBy("gram").agg(F.sum("size").alias("size"))
    sizes = sizes.unionByName(spark.read.parquet(f"{at}/texts").agg(F.lit("").alias("gram"), F.count("*").alias("size")))
    sizes.repartitionByRange(max(1, p // 8), "gram").sortWithinPartitions("gram").write.parquet(f"{at}/grams")
    return name


def segments(spark: SparkSession, root: str) -> list[str]:
    """Those that are whole."""
    return [s for s in shared.children(spark, root) if s.startswith("s") and shared.exists(spark, f"{root}/{s}/grams/_SUCCESS")]


def needs(words: list[str]) -> list[tuple[str, bool]]:
    """(gram, whether others that begin with it count as well) of the terms: a text has all terms only if it has a gram for each."""
    whole = {w[k : k + SIZE] for w in words for k in range(len(w) - SIZE + 1)}
    return [*((g, False) for g in sorted(whole)), *((w, True) for w in sorted({w for w in words if len(w) < SIZE}))]


def _matches(need: tuple[str, bool]) -> Column:
    return F.startswith("gram", F.lit(need[0])) if need[1] else F.col("gram") == need[0]


def _any(wanted: list[tuple[str, bool]]) -> Column:
    return reduce(Column.__or__, map(_matches, wanted))


def plan(spark: SparkSession, root: str, segment: str, query: str, most: int = 6) -> list[tuple[tuple[str, bool], int, bool]]:
    """(need, texts that have it, whether its postings will be read): one entry for each gram of the query.

    The rarest are read, `most` of them, as far as fewer than half the texts have them: beyond that verifying costs less than reading.
    """
    wanted = needs(text.terms_here(query))
    if not wanted:
        return []
    at = f"{root}/{segment}"
    table = spark.read.parquet(f"{at}/grams")
    asked = [("", False), *wanted]
    sums = table.where(_any(asked)).agg(*[F.coalesce(F.sum(F.when(_matches(x), F.col("size"))), F.lit(0)) for x in asked]).first()
    total, *sums = sums
    order = sorted(range(len(wanted)), key=lambda k: sums[k])
    chosen = {k for k in order[:most] if 2 * sums[k] < total}
    return [(x, int(sums[k]), k in chosen) for k, x in enumerate(wanted)]


def candidates(spark: SparkSession, at: str, read: list[tuple[str, bool]]) -> DataFrame:
    """(block, row) of the texts that have all of the grams."""
    lists = spark.read.parquet(f"{at}/postings").where(_any(read))
    parts = []
    exact = [x for x in read if not x[1]]
    if exact:
        parts.append(lists.where(F.col("gram").isin([g for g, _ in exact])).select("block", F.col("gram").alias("need"), "size", "rows"))
    for g, _ in (x for x in read if x[1]):
        union = lists.where(F.startswith("gram", F.lit(g))).select("block", F.explode("rows").alias("row")).distinct()
        union = union.groupBy("block").agg(F.collect_list("row").alias("rows"))
        parts.append(union.select("block", F.lit(g).alias("need"), F.size("rows").alias("size"), "rows"))
    per = reduce(DataFrame.unionByName, parts).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("size", "rows"))).alias("lists")).where(F.size("lists") == len(read))
    rest = F.slice("lists", F.lit(2), F.lit(max(1, len(read))))
    all_of = F.aggregate(rest, F.get(F.col("lists"), F.lit(0))["rows"], lambda left, x: F.array_intersect(left, x["rows"]))
    return per.select("block", F.explode(all_of).alias("row"))


def find(spark: SparkSession, root: str, query: str, column: str = "text", most_blocks: int = 1000) -> DataFrame:
    """The indexed rows whose text has all terms of the query, with their hit (text.hit). A query without terms finds nothing."""
    words, found = text.terms_here(query), []
    for segment in segments(spark, root):
        at = f"{root}/{segment}"
        texts = spark.read.parquet(f"{at}/texts")
        planned = plan(spark, root, segment, query)
        if not planned or any(n == 0 for _, n, _ in planned):
            texts = texts.where(F.lit(False))
        elif read := [x for x, _, chosen in planned if chosen]:
            some = shared.written(candidates(spark, at, read), "candidates")
            blocks = [r.block for r in some.select("block").distinct().limit(most_blocks + 1).collect()]
            if len(blocks) <= most_blocks:  # else so many that pruning would spare little
                texts = texts.where(F.col("block").isin(blocks))
            some = some.select(F.col("block").alias("_block"), F.col("row").alias("_row"))
            texts = texts.join(some, (F.col("block") == F.col("_block")) & ((F.col("n") % (1 << BLOCK_BITS)).cast("int") == F.col("_row")), "left_semi")
        found.append(text.with_hits(texts.drop("n", "block"), column, words))
    if not found:
        raise FileNotFoundError(f"no index in {root}")
    return reduce(DataFrame.unionByName, found)


def first_hits(spark: SparkSession, root: str, key: str, query: str, place: str = "n_page") -> DataFrame:
    """For each key with a hit its first place, that text and how many more hit, by the index."""
    hits = find(spark, root, query)
    return hits.groupBy(key).agg(F.min(place).alias(place), F.min_by("text", place).alias("text"), (F.count("*") - 1).alias("more"))

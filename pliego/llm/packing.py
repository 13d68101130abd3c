"""Best-fit packing of token sequences by minimum bin slack.

A document longer than the capacity is cut into full pieces and one rest. The pieces' lengths make a histogram of at
most `capacity` entries, whatever the number of documents; packing it is the driver's work. For each bin the longest
length left is placed first, and a bitset subset-sum over the lengths left (bit s: a sum of s can be reached) finds the
fullest combination for the rest of the bin. That combination is taken as often as the counts allow, then removed; each
time at least one length runs short of its multiplicity, so there are at most capacity * (1 + ln capacity) patterns,
however many documents. Pieces then get places by their rank within their length, which is computed in parallel: counts by
(length, hash bucket) give each bucket its base, and row numbers go on within buckets.

Defined results: a null text is an empty document (the end id alone); null ids, repeated ids and repeated rows are kept,
each packed on its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import doc_columns, materialize, prepare, shuffle_partitions
from .encoding import shared_encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, keep_space: bool, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document: its place, length and checksum, and with_ids its ids as little-endian uint32."""
    prepare(docs.sparkSession)
    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids

    def cut(batches):
        encoder = None
        for batch in batches:
            encoder = encoder or shared_encoder(tokenizer, keep_space)
            rows = []
            for i, tokens in zip(batch.column(0).to_pylist(), encoder.encode_batch([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids = np.append(tokens.astype("<u4"), np.uint32(end_id)).astype("<u4")
                for k, a in enumerate(range(0, len(ids), capacity)):
                    raw = ids[a : a + capacity].tobytes()
                    rows.append((i, k, a, len(raw) // 4, zlib.crc32(raw), raw)[: len(names)])
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names)

    return doc_columns(docs).mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how many bins, [(length, how often in each)]) for each pattern, in the order in which they are taken."""
    left = {n: c for n, c in counts.items() if c > 0}
    order = sorted(left, reverse=True)
    patterns = []
    while left:
        while order[0] not in left:
            order.pop(0)
        seed = order[0]
        room, bits, steps = capacity - seed, 1, []
        mask = (1 << (room + 1)) - 1
        for n in order:
            if n > room or n not in left:
                continue
            k, c = min(left[n] - (n == seed), room // n), 1
            while k > 0:
                c = min(c, k)
                steps.append((n, c, bits))
                bits |= (bits << (n * c)) & mask
                k, c = k - c, c * 2
            if bits >> room & 1:
                break
        at, chosen = bits.bit_length() - 1, defaultdict(int, {seed: 1})
        for n, c, before in reversed(steps):
            if not before >> at & 1:
                chosen[n] += c
                at -= n * c
        times = min(left[n] // m for n, m in chosen.items())
        patterns.append((times, sorted(chosen.items(), reverse=True)))
        for n, m in chosen.items():
            left[n] -= times * m
            if not left[n]:
                del left[n]
        if len(order) > 2 * len(left) + 8:
            order = [n for n in order if n in left]
    return patterns


def places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, how often in a sequence, first offset), by rank."""
    out, ranks, sequence = defaultdict(list), defaultdict(int), 0
    for times, chosen in patterns:
        offset = 0
        for n, m in chosen:
            out[n].append((ranks[n], sequence, m, offset))
            ranks[n] += times * m
            offset += n * m
        sequence += times
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, keep_space: bool = False, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with sequence_id (gapless from 0) and offset."""
    spark = docs.sparkSession
    cut, _ = materialize(pieces(docs, tokenizer, end_id, capacity, keep_space, with_ids), "pieces")
    n = 4 * shuffle_partitions(spark)
    cut = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)))
    sums = cut.groupBy("length", "_bucket").agg(F.count("*").alias("_count"))
    histogram = {r.length: r.n for r in sums.groupBy("length").agg(F.sum("_count").alias("n")).collect()}  # capacity rows at most
    table = places(pack_histogram(histogram, capacity))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("length", "_bucket", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("_rank", F.row_number().over(within)).join(base, ["length", "_bucket"])
    columns = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids
    ranked = ranked.select(*columns, (F.col("_base") + F.col("_rank") - 1).alias("_rank"))
    table = spark.sparkContext.broadcast(table)  # at most capacity * (1 + ln capacity) rows of four numbers

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for m in np.unique(length):
                at = np.flatnonzero(length == m)
                rows = table.value[m]
                rows = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                nth = rank[at] - rows[:, 0]
                sequence[at] = rows[:, 1] + nth // rows[:, 2]
                offset[at] = rows[:, 3] + nth % rows[:, 2] * m
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", ids binary" * with_ids + ", sequence_id long, offset long")

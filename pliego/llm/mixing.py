"""Mixing sources to target weights, in DataFrame operations only.

Each source's documents, in an order by hash bucket and id, make one stream of words, which is packed into blocks of
`block` words (the last may be shorter). Sources get shares of budget * all words by weight; a share stops at cap *
the source's size and its excess goes to the others by weight. The output consists of shards of `shard_slots` slots, each for one block. What
slots take is drawn by lot: a source has as many lots as its target has blocks, and a swap-or-not shuffle of all lots deals them to slots, so a
shard's counts of the sources are a multinomial draw without replacement (with replacement, sources of small tables would end some
per cent off their targets). A source's lots are numbered; lot j asks for block perm_e(j mod blocks) with e = j div blocks, where perm_e is a
shuffle of the same kind keyed by source and e. So no block is drawn more than `cap` times. Slots and
blocks are joined by block number, which is unique on either side: no key is hot, whatever the sizes of sources.

Only ids and sizes are laid out; texts are joined at the end, by row. All numbers of partitions, buckets and lots follow from the data's size.

Defined results: null texts have size 0 and are never taken; null sources are one source, last in order; null ids and
repeated rows are rows like others, each with its own stretch of the stream; an empty table gives no rows. Everything is a
function of the rows and the seed, so reruns agree. Other columns are ignored by mix(), kept by mixed_texts().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import WORD, materialize, prepare

ROUNDS = 8


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, cap: float) -> DataFrame:
    """sizes (source, source_size) with sidx (from 0, by code point, null last) and target: one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("sidx", F.row_number().over(order) - 1)
    s = s.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("sidx"), F.lit(len(weights))) + 1))
    s = s.withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
    filled = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), "sidx")
    so_far, onward, everything = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(budget))
    s = s.withColumn("_level", (total - F.coalesce(F.sum("_cap").over(so_far), F.lit(0.0))) / F.sum("_w").over(onward))
    # Sources fill up in order of cap by weight; the level at the first that doesn't is the highest of those that don't.
    s = s.withColumn("_open", F.when(F.col("_cap") > F.col("_level") * F.col("_w"), F.col("_level")))
    s = s.withColumn("_level", F.max("_open").over(everything))
    return s.select("source", "sidx", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))).alias("target"))


def permuted(x: Column, size: Column, key: list[str], seed: int) -> Column:
    """The image of x, a number from 0 up to size, under a swap-or-not shuffle keyed by key.

    A fold over the rounds, not one projection for each: nested projections would make the plan grow exponentially.
    """

    def round_(at: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(seed), r, *key), size) - at, size)
        swap = F.pmod(F.xxhash64(F.lit(seed), F.lit("swap"), r, *key, F.greatest(at, partner)), F.lit(2)) == 1
        return F.when(swap, partner).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, round_)


def lots(sources: DataFrame, block: int) -> DataFrame:
    """sources with blocks, their number of lots and the first of their lots; a source's lots take its mean words to a block each."""
    s = sources.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    s = s.withColumn("lots", F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5).cast("long"))
    return s.withColumn("first", F.sum("lots").over(Window.orderBy("sidx")) - F.col("lots"))


def slots(sources: DataFrame, block: int, shard_slots: int, seed: int, width: int = 1 << 14) -> DataFrame:
    """(shard, slot, sidx, block) of the whole output."""
    spark = sources.sparkSession
    s, _ = materialize(lots(sources, block).select("sidx", "blocks", "lots", "first"), "lots")
    n = s.agg(F.coalesce(F.sum("lots"), F.lit(0))).first()[0]
    drawn = spark.range(0, n, 1, max(1, -(-n // (1 << 18)))).withColumnRenamed("id", "slot")
    drawn = drawn.withColumn("lot", permuted(F.col("slot"), F.lit(n), [], seed)) if n else drawn.withColumn("lot", F.col("slot"))
    # Which source a lot is of: sources' ranges of lots, cut where lots have the same number div width, in two steps so that no array is long.
    coarse = width << 12
    last = F.col("first") + F.col("lots") - 1
    cut = s.where("lots > 0").select("*", F.explode(F.sequence(F.floor(F.col("first") / coarse), F.floor(last / coarse))).alias("_c"))
    low, high = F.greatest(F.col("first"), F.col("_c") * coarse), F.least(last, (F.col("_c") + 1) * coarse - 1)
    cut = cut.select("sidx", "blocks", "lots", "first", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))).alias("_w"))
    drawn = drawn.withColumn("_w", F.floor(F.col("lot") / width)).join(cut, "_w").where((F.col("lot") >= F.col("first")) & (F.col("lot") < F.col("first") + F.col("lots")))
    drawn = drawn.withColumn("_j", F.col("lot") - F.col("first")).withColumn("epoch", F.floor(F.col("_j") / F.col("blocks")))
    taken = permuted(F.pmod("_j", "blocks"), F.col("blocks"), ["sidx", "epoch"], seed)
    return drawn.select(F.floor(F.col("slot") / shard_slots).alias("shard"), "slot", "sidx", taken.alias("block"))


def laid_out(rows: DataFrame, buckets: int, stretch: int = 4096) -> DataFrame:
    """rows (row, sidx, doc_id, size, tie) with at, the first word's place in the source's stream."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(buckets)))
    # Prefix sums in two steps, so that no window is long: over the buckets of a stretch, and over stretches.
    sums = rows.groupBy("sidx", "bucket").agg(F.sum("size").alias("n")).withColumn("stretch", F.floor(F.col("bucket") / stretch))
    upto = lambda *key, by: F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = sums.groupBy("sidx", "stretch").agg(F.sum("n").alias("n")).select("sidx", "stretch", upto("sidx", by="stretch").alias("before"))
    base = sums.select("sidx", "stretch", "bucket", upto("sidx", "stretch", by="bucket").alias("inner")).join(whole, ["sidx", "stretch"])
    base = base.select("sidx", "bucket", (F.col("before") + F.col("inner")).alias("base"))
    within = Window.partitionBy("sidx", "bucket").orderBy("doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("before", F.sum("size").over(within) - F.col("size"))
    return rows.join(base, ["sidx", "bucket"]).select("row", "sidx", "size", (F.col("base") + F.col("before")).alias("at"))


class Mix:
    """sources: one row per source; rows: one per document row, with its payload; placed: their places in streams; drawn: (row, block, skip, words, times)."""

    def __init__(self, docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, cap: int = 2, block: int = 32, shard_slots: int = 1024, bucket_rows: int = 200, seed: int = 7, payload: tuple[str, ...] = ()):
        prepare(docs.sparkSession)
        rows = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["source"].alias("source"), word_count(docs["text"]).alias("size"), F.xxhash64(docs["text"], docs["source"]).alias("tie"), *([F.struct(*[docs[c] for c in payload]).alias("payload")] if payload else []))
        self.rows, _ = materialize(rows, "mix-rows")
        sizes = self.rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
        self.sources, _ = materialize(targets(sizes.drop("n"), weights, budget, cap), "mix-sources")
        n = self.rows.count()  # of a written table
        sources = self.sources.select(F.col("source").alias("_s"), "sidx")
        numbered = self.rows.where("size > 0").select("row", "doc_id", "source", "size", "tie").join(sources, F.col("source").eqNullSafe(F.col("_s")))
        self.placed, _ = materialize(laid_out(numbered, max(1, n // bucket_rows)), "mix-places")
        self.slots = slots(self.sources, block, shard_slots, seed)
        times = self.slots.groupBy("sidx", "block").agg(F.count("*").alias("times"))
        at, end = F.col("at"), F.col("at") + F.col("size")
        parts = self.placed.select("*", F.explode(F.sequence(F.floor(at / block), F.floor((end - 1) / block))).alias("block"))
        first, last = F.greatest(at, F.col("block") * block), F.least(end, (F.col("block") + 1) * block)
        parts = parts.select("sidx", "row", "block", (first - at).alias("skip"), (last - first).alias("words"))
        # Slots come from a range, whose size the planner knows, but not that of the blocks; both are too many to broadcast.
        self.drawn = parts.join(times.hint("merge"), ["sidx", "block"]).select("row", "skip", "words", "times")

    def taken(self) -> DataFrame:
        got = self.drawn.groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        sources = self.sources.withColumnRenamed("source", "_s")
        out = self.rows.join(got, "row", "left").join(sources, F.col("source").eqNullSafe(F.col("_s")))
        return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document row: doc_id, source, size, source_size, target, taken."""
    return Mix(docs, **options).taken()


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row of docs appears once or twice, as its blocks were drawn, with the words that each draw takes.

    A row of which a draw takes all words keeps its text as it is; else its words are joined by a space. n_chars, where
    there is one, follows the text.
    """
    keep = [c for c in docs.columns if c not in ("doc_id", "source", "n_chars")]
    m = Mix(docs, payload=tuple(keep), **options)
    copies = m.drawn.select("row", "skip", "words", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
    copies = copies.groupBy("row", "copy").agg(F.sort_array(F.collect_list(F.struct("skip", "words"))).alias("parts"), F.sum("words").alias("got"))
    out = copies.join(m.rows, "row")
    text = F.col("payload").getField("text")
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    some = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(F.col("_words"), (p["skip"] + 1).cast("int"), p["words"].cast("int")))), " ")
    out = out.withColumn("_words", F.when(F.col("got") < F.col("size"), words)).withColumn("_text", F.when(F.col("got") == F.col("size"), text).otherwise(some))
    own = {"doc_id": F.col("doc_id"), "source": F.col("source"), "text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*[own[c].alias(c) if c in own else F.col("payload").getField(c).alias(c) for c in docs.columns])

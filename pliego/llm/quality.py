"""Quality rules by cross-document line frequency.

Lines are normalised (lower case, ASCII white space collapsed, digits as 0) and hashed; for each host (source) the distinct
documents that hold a line are counted, where documents of equal text count once, so exact copies alone make no line
frequent. A line in more documents of its host than the limit, the larger of `min_docs` (so few that it only says what repeats at all) and
`share` of the host's documents, is removed; a document that loses more than `max_lost` of its words that way is rejected, as one that
fails the base rules is. Only hashes and counts are shuffled, and all counts combine before their shuffle, so neither a
hot host nor a hot line gathers in one task.

Defined results: a null or empty text has no words, lines or symbols, and fails the base rules; a null source is a
host of its own; null and repeated ids are rows like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, prepare

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
_DIGITS = re.compile("[0-9]")

FEATURES = "row long, doc_id long, source string, content long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<long>"


def repeated_words(words: list) -> int:
    """How many words lie in a three-word window that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    size = len(seen)
    pairs = ids[:-1] * size + ids[1:]
    if size > 1 << 20:  # three ids no longer fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1].reshape(-1)
    _, where, counts = np.unique(pairs[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[where.reshape(-1)] > 1)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[twice + k] = True
    return int(covered.sum())


def line_key(line: str) -> int:
    """The hash of a line's normal form."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(b" ".join(_DIGITS.sub("0", line).lower().encode("utf-8", "surrogatepass").split())) - (1 << 63)


def text_features(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then the hashes and words of its distinct normalised lines."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen, duplicates, lines = set(), 0, {}
    for line in text.split("\n"):
        if n := len(line.encode("utf-8", "surrogatepass").split()):
            duplicates += line in seen
            seen.add(line)
            key = line_key(line)
            lines[key] = lines.get(key, 0) + n
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), duplicates, repeated_words(words), list(lines), list(lines.values()))


def features(docs: DataFrame, row: str | None = None) -> DataFrame:
    """FEATURES of each row. row: a column that numbers rows; without one they are numbered as they come."""
    prepare(docs.sparkSession)
    names = [x.split()[0] for x in FEATURES.split(", ")][1:]
    schema = FEATURES.split(", ", 1)[1]

    def measure(batches):
        from xxhash import xxh64_intdigest

        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6, pa.list_(pa.int64()), pa.list_(pa.int64())]
        for batch in batches:
            texts = batch.column(2).to_pylist()
            content = [xxh64_intdigest((t or "").encode("utf-8", "surrogatepass")) - (1 << 63) for t in texts]
            columns = [batch.column(0), batch.column(1), content, *zip(*map(text_features, texts), strict=True)]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names) if texts else pa.RecordBatch.from_pylist([], pa.schema(list(zip(names, kinds, strict=True))))
            yield made.append_column("row", batch.column(3)) if row else made

    own = [docs[row].cast("long").alias("row")] if row else []
    chosen = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), docs["text"].cast("string").alias("text"), *own)
    if row:
        return chosen.mapInArrow(measure, schema + ", row long").select("row", *names)
    return chosen.mapInArrow(measure, schema).select(F.monotonically_increasing_id().alias("row"), *names)


def frequent_lines(measured: DataFrame, min_docs: int, share: float) -> DataFrame:
    """(source, line) of the lines above their host's limit."""
    contents = measured.groupBy("source").agg(F.countDistinct("content").alias("_docs"))
    limits = contents.select(F.col("source").alias("_host"), F.greatest(F.lit(float(min_docs)), F.col("_docs") * F.lit(share)).alias("_limit"))
    held = measured.select("source", "content", F.explode("lines").alias("line"))
    counts = held.distinct().groupBy("source", "line").agg(F.count("*").alias("_n")).where(F.col("_n") > min_docs)
    return counts.join(limits, F.col("source").eqNullSafe(F.col("_host"))).where("_n > _limit").select("source", "line")


def frequent_words(measured: DataFrame, min_docs: int, share: float) -> DataFrame:
    """(row, line, n): the lines above their host's limit that each row has, with their words there."""
    # Written first: the join below then has plain exchanges, which adaptive execution splits where a line is very common.
    above, _ = materialize(frequent_lines(measured, min_docs, share), "frequent-lines")
    above = above.select(F.col("source").alias("_host"), F.col("line").alias("_line"))
    held = measured.select("row", "source", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("row", "source", F.col("x.lines").alias("line"), F.col("x.line_words").alias("n"))
    return held.join(above, F.col("source").eqNullSafe(F.col("_host")) & (F.col("line") == F.col("_line"))).select("row", "line", "n")


def verdict(figures: DataFrame, max_lost: float, min_words: int, max_repeat: float) -> DataFrame:
    """figures with base_failed and kept."""
    failed = (F.col("n_words") < min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(int(round(100 * max_repeat))) * F.col("n_words"))
    return figures.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("frequent_words") <= F.lit(max_lost) * F.col("n_words")))


def judge(docs: DataFrame, min_docs: int = 3, share: float = 0.02, max_lost: float = 0.3, min_words: int = 50, max_repeat: float = 0.5) -> DataFrame:
    """One row per document row: the base figures, frequent_words (words of the lines removed), base_failed, kept."""
    measured, _ = materialize(features(docs), "quality")
    lost = frequent_words(measured, min_docs, share).groupBy("row").agg(F.sum("n").alias("frequent_words"))
    out = measured.drop("lines", "line_words", "content").join(lost, "row", "left").withColumn("frequent_words", F.coalesce("frequent_words", F.lit(0)))
    return verdict(out, max_lost, min_words, max_repeat).drop("row")


def cleaned(docs: DataFrame, min_docs: int = 3, share: float = 0.02, max_lost: float = 0.3, min_words: int = 50, max_repeat: float = 0.5) -> DataFrame:
    """The rows that judge keeps, their texts without the lines above their host's limit; all columns stay, and n_chars, where there is one, follows the text.

    Rows are numbered and written first, so that the lines to remove come back to their own row.
    """
    prepare(docs.sparkSession)
    names = docs.columns
    boxed = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[docs[c] for c in names]).alias("doc"))
    numbered, _ = materialize(boxed, "numbered")
    own = numbered.select("row", "doc.doc_id", "doc.source", "doc.text")
    measured, _ = materialize(features(own, "row"), "quality")
    gone = frequent_words(measured, min_docs, share).groupBy("row").agg(F.sum("n").alias("frequent_words"), F.collect_list("line").alias("gone"))
    judged = measured.select("row", "n_words", "n_repeat_words").join(gone, "row", "left").withColumn("frequent_words", F.coalesce("frequent_words", F.lit(0)))
    kept = verdict(judged, max_lost, min_words, max_repeat).where("kept").select("row", "gone")

    def without(batches):
        for batch in batches:
            texts = []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if gone:
                    lost = set(gone)
                    text = "\n".join(x for x in text.split("\n") if not x.strip(SPACES) or line_key(x) not in lost)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "cleaned"])

    texts = numbered.join(kept, "row").select("row", F.col("doc.text").cast("string").alias("text"), "gone").mapInArrow(without, "row long, cleaned string")
    out = numbered.join(texts, "row")
    new = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col("doc").getField(c).alias(c) for c in names])

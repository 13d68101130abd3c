"""Language-model scores by context-tree weighting over bytes.

A text is its lower-cased words joined by spaces and one end byte. Each byte is eight binary decisions; each decision has
a Krichevsky-Trofimov estimate at every depth of context, from none to `depth` bytes, and a node of the context tree
weighs its own estimate against its children's product: Pw = (Pe + prod Pw) / 2. Scoring with the counts of all training
documents mixes the estimates along a byte's contexts by these weights; where training never saw the deeper context, the
deepest estimate seen stands for it. The code length in bits per byte is -score * log2(10) / bytes.

How it is distributed. Documents are packed into chunks. A chunk sends its distinct byte n-grams (most recent context byte
first) and its distinct words with their training counts to buckets; n-grams that share their two most recent context bytes
share a bucket, so a bucket holds whole subtrees. Buckets merge counts (first in parts, where many chunks meet), the nodes
of depth one and none, 2 ** 16 at most, are summed and finished on the driver, and each bucket evaluates its n-grams.
Answers go back to the chunks that asked, in rows of one chunk and bucket each. What moves grows with the text, by
distinct n-grams and words per chunk, and no task holds more than a bucket's distinct entries and a chunk.

Defined results: a null or empty text is the end byte alone; training documents are those with crc32(id) mod 7 <> 2, and
a row without an id isn't one of them, nor held out; without training documents every bit has probability 1/2; rows that
share an id are each counted and scored; an empty table gives no rows; other columns are ignored. Words are told apart
by 64-bit hashes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import CHUNKS, NO_ID, id_column, materialize, pack_chunks, prepare, release_shuffles, shuffle_partitions, unpack_chunk

END = b"\n"
FOLDS, HELD_OUT = 7, 2
COUNTS = "bucket int, chunk_id long, keys binary, counts binary"
#: Chunks whose rows of a bucket one task merges at once.
FAN_IN = 256


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series at x + 8, for x > 0."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their summed counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k = k[order]
    heads = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
    return k[heads], np.add.reduceat(c[order], heads) if len(k) else c


class Tree:
    """The nodes of depths low to depth under counts of n-grams; low_sums are what the nodes of depth low - 1 need."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, low: int):
        self.depth, self.low = depth, low
        seen = counts > 0
        keys, counts = keys[seen], counts[seen].astype(np.float64)
        self.nodes: dict[tuple[int, int], tuple] = {}
        below: dict[int, tuple] = {}
        for d in range(depth, low - 1, -1):
            if d < depth:
                keys, counts = merged([((keys >> np.uint64(16)) << np.uint64(8)) | (keys & np.uint64(255))], [counts])
            above = {}
            for k in range(8):
                child = keys >> np.uint64(7 - k)
                node = child >> np.uint64(1)
                heads = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.empty(0, np.int64)
                names = node[heads]
                n = np.add.reduceat(counts, heads) if len(heads) else counts
                ones = np.add.reduceat(counts * (child & np.uint64(1)).astype(np.float64), heads) if len(heads) else counts
                own = log_kt(n - ones, ones)
                weight = np.ones(len(names))
                if d < depth:
                    kids, kid_weights = below[k]
                    up = ((kids >> np.uint64(k + 8)) << np.uint64(k)) | (kids & np.uint64((1 << k) - 1))
                    total = np.bincount(np.searchsorted(names, up), kid_weights, len(names))
                    both = np.logaddexp(own, total)
                    weight, own = np.exp(own - both), both - np.log(2)
                self.nodes[d, k] = (names, (ones + 0.5) / (n + 1.0), weight)
                above[k] = (names, own)
            below = above
        self.keys, self.counts, self.below = keys, counts, below  # at depth low

    def top(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of depth low - 1: the n-grams (context, byte) and their counts; the nodes (context, bits from a leading 1) and the sums of their children's log Pw."""
        grams = ((self.keys >> np.uint64(16)) << np.uint64(8)) | (self.keys & np.uint64(255))
        names = [((n >> np.uint64(k + 8)) << np.uint64(8)) | np.uint64(1 << k) | (n & np.uint64((1 << k) - 1)) for k, (n, _) in self.below.items()]
        return (*merged([grams], [self.counts]), *merged(names, [w for _, w in self.below.values()]))

    def bits(self, keys: np.ndarray, k: int, bottom=None) -> np.ndarray:
        """The probability of each key's bit k as depths low and more mix it; NaN where none was seen."""
        p = np.full(len(keys), np.nan)
        byte, one = keys & np.uint64(255), ((keys >> np.uint64(7 - k)) & np.uint64(1)) == 1
        for d in range(self.depth, self.low - 1, -1):
            names, kt, weight = self.nodes[d, k]
            if not len(names):
                continue
            wanted = (((keys >> np.uint64(8 * (self.depth - d) + 8)) << np.uint64(8)) | byte) >> np.uint64(8 - k)
            at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
            found = names[at] == wanted
            q = np.where(one, kt[at], 1 - kt[at])
            mix = np.where(np.isnan(p), q, weight[at] * q + (1 - weight[at]) * p)
            p = np.where(found, mix, p)
        return p


class Top:
    """The nodes of depths one and none, from summed counts (context, byte) and sums of log Pw (context, node)."""

    def __init__(self, counts: np.ndarray, sums: np.ndarray):
        self.kt, self.weight, self.seen = np.full((2, 256, 256), 0.5), np.ones((2, 256, 256)), np.zeros((2, 256, 256), bool)
        counts = counts.reshape(256, 256).astype(np.float64)
        sums = sums.reshape(256, 256)
        for d in (1, 0):
            if d == 0:
                counts, sums = counts.sum(axis=0, keepdims=True), weighted.sum(axis=0, keepdims=True)
            weighted = np.zeros((len(counts), 256))
            for k in range(8):
                ones_zeros = counts.reshape(len(counts), 1 << k, 2, -1).sum(axis=3)
                zeros, ones = ones_zeros[:, :, 0], ones_zeros[:, :, 1]
                at = slice(1 << k, 2 << k)
                own = log_kt(zeros, ones)
                both = np.logaddexp(own, sums[:, at])
                self.kt[d, : len(counts), at] = (ones + 0.5) / (zeros + ones + 1)
                self.weight[d, : len(counts), at] = np.exp(own - both)
                self.seen[d, : len(counts), at] = zeros + ones > 0
                weighted[:, at] = np.where(zeros + ones > 0, both - np.log(2), 0.0)

    def log10(self, keys: np.ndarray, tree: Tree) -> np.ndarray:
        """log10 of each n-gram's last byte after its context."""
        out = np.zeros(len(keys))
        last = ((keys >> np.uint64(8 * tree.depth)) & np.uint64(255)).astype(np.int64)
        byte = (keys & np.uint64(255)).astype(np.int64)
        for k in range(8):
            p = tree.bits(keys, k)
            node, one = (1 << k) | (byte >> (8 - k)), (byte >> (7 - k) & 1) == 1
            for d, context in ((1, last), (0, np.zeros_like(last))):
                q = np.where(one, self.kt[d, context, node], 1 - self.kt[d, context, node])
                w = self.weight[d, context, node]
                p = np.where(self.seen[d, context, node], np.where(np.isnan(p), q, w * q + (1 - w) * p), p)
            out += np.log10(np.where(np.isnan(p), 0.5, p))
        return out


def normal_bytes(text: bytes) -> tuple[list[bytes], bytes]:
    words = text.lower().split()
    return words, b" ".join(words) + END


def gram_keys(texts: list[bytes], depth: int) -> np.ndarray:
    """The n-gram of each byte of the texts, in order; a text's first bytes have end bytes for context."""
    if not texts:
        return np.empty(0, np.uint64)
    pad = END * depth
    raw = np.frombuffer(pad + pad.join(texts), np.uint8).astype(np.uint64)
    n = len(raw) - depth
    key = np.zeros(n, np.uint64)
    for d in range(1, depth + 1):
        key = (key << np.uint64(8)) | raw[depth - d : depth - d + n]
    key = (key << np.uint64(8)) | raw[depth:]
    lengths = np.array([len(t) for t in texts])
    starts = np.cumsum(lengths + depth) - lengths - depth
    return key[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]


def training(ids: np.ndarray) -> np.ndarray:
    return np.fromiter((i != NO_ID and zlib.crc32(b"%d" % i) % FOLDS != HELD_OUT for i in ids.tolist()), bool, len(ids))


def squeezed(numbers: np.ndarray, ordered: bool = False) -> bytes:
    """Numbers as compressed bytes; ordered ones as differences, which compress better."""
    import zstandard

    numbers = numbers.astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress((np.diff(numbers, prepend=np.zeros(1, "<u8")) if ordered else numbers).tobytes())


def restored(data: bytes, ordered: bool = False) -> np.ndarray:
    import zstandard

    numbers = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u8")
    return np.cumsum(numbers, dtype=np.uint64) if ordered else numbers


def _word_key(word: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word, 1)


def _blocks(ids: np.ndarray, offsets: np.ndarray, most: int = 2 << 20):
    """Runs of documents of about `most` bytes, so that arrays of a number per byte stay small."""
    a = 0
    while a < len(ids):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b
        a = b


class Lookup:
    """Places of keys in an array of distinct ones, by open addressing: one or two random reads a key, where a search takes twenty."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(4, int(2 * len(keys)).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = self.table[at] < 0
            self.table[at[free]] = left[free]
            lost = self.table[at] != left
            left, at = left[lost], (at[lost] + 1) & (len(self.table) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """All keys must be there."""
        at = self._home(keys)
        out = self.table[at]
        bad = np.flatnonzero(self.keys[out] != keys)
        at = at[bad]
        while len(bad):
            at = (at + 1) & (len(self.table) - 1)
            out[bad] = self.table[at]
            wrong = self.keys[out[bad]] != keys[bad]
            bad, at = bad[wrong], at[wrong]
        return out


class Buckets:
    """Buckets 0 to n - 1 hold n-grams by their two most recent context bytes, n to 2n - 1 words by hash."""

    def __init__(self, n: int, depth: int):
        self.n, self.depth = n, depth

    def of_grams(self, keys: np.ndarray) -> np.ndarray:
        pair = (keys >> np.uint64(8 * (self.depth - 1))) & np.uint64(0xFFFF)
        return (((pair * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)) * np.uint64(self.n) >> np.uint64(32)).astype(np.int64)

    def of_words(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(32)) * np.uint64(self.n) >> np.uint64(32)).astype(np.int64) + self.n

    def deal(self, keys: np.ndarray, buckets: np.ndarray):
        """(bucket, places of its keys, in their order)"""
        order = np.argsort(buckets, kind="stable")
        b = buckets[order]
        heads = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.empty(0, np.int64)
        for h, e in zip(heads, np.r_[heads[1:], len(b)] if len(b) else heads, strict=True):
            yield int(b[h]), order[h:e]


def chunk_words(offsets, text) -> tuple[dict[bytes, int], list[np.ndarray], list[bytes]]:
    """The distinct words of a chunk, numbered as they come, each document's words as numbers, and its normal form."""
    names: dict[bytes, int] = {}
    numbers, forms = [], []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        words, form = normal_bytes(text[a:b])
        numbers.append(np.array([names.setdefault(w, len(names)) for w in words], np.int32))
        forms.append(form)
    return names, numbers, forms


def counted(chunks: DataFrame, buckets: Buckets) -> DataFrame:
    """Each chunk's distinct n-grams and words with their training counts, a row for each bucket."""
    depth = buckets.depth

    def count(batches):
        for batch in batches:
            for chunk, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, offsets, text = unpack_chunk(*packed)
                train = training(ids)
                found, times = [], []
                names, docs, forms = chunk_words(offsets, text)
                for a, b in _blocks(ids, offsets):
                    parts = forms[a:b]
                    for use in (True, False):
                        keys = np.sort(gram_keys([t for t, y in zip(parts, train[a:b], strict=True) if y == use], depth))
                        heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
                        found.append(keys[heads])
                        times.append(np.diff(np.r_[heads, len(keys)]) * use)
                grams = merged(found, times)
                n = np.zeros(len(names), np.int64)
                for numbers, y in zip(docs, train, strict=True):
                    if y:
                        n += np.bincount(numbers, minlength=len(names)) if len(numbers) > len(names) // 8 else 0
                        if len(numbers) <= len(names) // 8:
                            np.add.at(n, numbers, 1)
                words = merged([np.fromiter(map(_word_key, names), np.uint64, len(names)), np.array([_word_key(b"")], np.uint64)], [n, np.array([train.sum()])])
                rows = []
                for (keys, times), bucket in ((grams, buckets.of_grams(grams[0])), (words, buckets.of_words(words[0]))):
                    rows += [(b, chunk, squeezed(keys[at], True), squeezed(times[at])) for b, at in buckets.deal(keys, bucket)]
                for a in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 64], strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "chunk_id", "keys", "counts"])

    return chunks.mapInArrow(count, COUNTS)


def summed(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows of equal key (bucket first) merged to one, with 8-byte counts; chunk_id is the least."""

    def add(batches):
        held, now, size = ([], [], []), None, 0

        def out():
            k, c = merged(held[0], held[1])
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([squeezed(k, True)], pa.binary()), pa.array([squeezed(c)], pa.binary())], ["bucket", "chunk_id", "keys", "counts"])

        for batch in batches:
            for b, part, k, c in zip(*(batch.column(x).to_pylist() for x in ("bucket", "part", "keys", "counts")), strict=True):
                if (b, part) != now:
                    if now is not None:
                        yield out()
                    held, now, size = ([], []), (b, part), 0
                k = restored(k, True)
                held[0].append(k)
                held[1].append(restored(c).astype(np.int64))
                size += len(k)
                if size > 2_000_000 and len(held[0]) > 1:
                    k, c = merged(held[0], held[1])
                    held, size = ([k], [c]), 0
        if now is not None:
            yield out()

    n = shuffle_partitions(rows.sparkSession)
    return rows.repartition(n, *key).sortWithinPartitions(*key).select("bucket", "part", "keys", "counts").mapInArrow(add, COUNTS)


def score(docs: DataFrame, depth: int = 5, chunk_bytes: int = 16 << 20) -> DataFrame:
    """One row per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, and bytes, the length of its normal form."""
    spark = docs.sparkSession
    prepare(spark)
    chunks, _ = materialize(pack_chunks(docs, chunk_bytes), "lm-chunks")
    n_chunks = max(1, chunks.select("chunk_id").count())
    buckets = Buckets(2 * shuffle_partitions(spark), depth)
    rows, _ = materialize(counted(chunks, buckets), "lm-counts")
    parts = -(-n_chunks // FAN_IN)
    part = F.pmod(F.xxhash64("chunk_id"), F.lit(parts))
    sums = rows.withColumn("part", part if parts > 1 else F.lit(0).cast("long"))
    sums = summed(sums, ["bucket", "part"])
    if parts > 1:
        sums = summed(sums.withColumn("part", F.lit(0).cast("long")), ["bucket"])
    sums, _ = materialize(sums, "lm-sums")
    release_shuffles(spark)

    def tops(batches):
        for batch in batches:
            for b, k, c in zip(*(batch.column(x).to_pylist() for x in ("bucket", "keys", "counts")), strict=True):
                k, c = restored(k, True), restored(c).astype(np.int64)
                if b >= buckets.n:
                    what, name, value = np.array([2, 3]), np.array([0, 0]), np.array([c.sum(), (c > 0).sum()], np.float64)
                else:
                    grams, times, nodes, logs = Tree(k, c, depth, 2).top()
                    what, name, value = np.repeat([0, 1], [len(grams), len(nodes)]), np.r_[grams, nodes].astype(np.int64), np.r_[times, logs].astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(what, pa.int64()), pa.array(name, pa.int64()), pa.array(value)], ["what", "name", "value"])

    top_counts, top_sums, totals = np.zeros(1 << 16), np.zeros(1 << 16), [0.0, 0.0]
    for r in sums.mapInArrow(tops, "what long, name long, value double").groupBy("what", "name").agg(F.sum("value").alias("value")).collect():  # 2 ** 17 + 2 at most
        if r.what < 2:
            (top_counts, top_sums)[r.what][r.name] = r.value
        else:
            totals[r.what - 2] = r.value
    top = spark.sparkContext.broadcast(Top(top_counts, top_sums))
    train_tokens, log_base = int(totals[0]), float(np.log10(totals[0] + totals[1] + 1))  # N + 1 * (V + 1)

    def evaluate(batches):
        for batch in batches:
            for b, keys, c in zip(*(batch.column(x).to_pylist() for x in ("bucket", "keys", "counts")), strict=True):
                if b < buckets.n:
                    k = restored(keys, True)
                    c = top.value.log10(k, Tree(k, restored(c).astype(np.int64), depth, 2)).astype("<f4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([keys], pa.binary()), pa.array([c], pa.binary())], ["bucket", "keys", "values"])

    values, _ = materialize(sums.mapInArrow(evaluate, "bucket int, keys binary, values binary"), "lm-values")
    # A bucket's values come first, then the chunks that ask; where many do, the values go to each of their parts.
    given = values.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.lit(-1).cast("long").alias("chunk_id"), "keys", "values")
    asked = rows.select("bucket", (part if parts > 1 else F.lit(0).cast("long")).alias("part"), "chunk_id", "keys", F.lit(None).cast("binary").alias("values"))

    def answer(batches):
        own = vals = None
        for batch in batches:
            out = []
            for b, _, chunk, keys, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                asked, keys = keys, restored(keys, True)
                if chunk < 0:
                    own, vals = keys, restored(values) if b >= buckets.n else np.frombuffer(values, "<f4")
                    continue
                found = vals[np.searchsorted(own, keys)]  # words come back in the order of their keys, which the chunk knows
                out.append((chunk, b, None, squeezed(found)) if b >= buckets.n else (chunk, b, asked, found.tobytes()))
            for a in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[a : a + 64], strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["chunk_id", "bucket", "keys", "values"])

    n = shuffle_partitions(spark)
    met = given.unionByName(asked).repartition(n, "bucket", "part").sortWithinPartitions("bucket", "part", "chunk_id")
    answers = met.mapInArrow(answer, "chunk_id long, bucket int, keys binary, values binary")
    bodies = chunks.select("chunk_id", F.lit(1 << 30).alias("bucket"), F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("values"), "doc_ids", "lengths", "body", "rest")
    empty = [F.lit(None).cast("binary").alias(c) for c in ("doc_ids", "lengths", "body", "rest")]
    joined = answers.select("chunk_id", "bucket", "keys", "values", *empty).unionByName(bodies).repartition(n, "chunk_id").sortWithinPartitions("chunk_id", "bucket")

    def finish(batches):
        keys, logs, words = [], [], {}
        for batch in batches:
            for _, bucket, k, v, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if packed[2] is None:
                    if k is None:
                        words[bucket] = restored(v)
                    else:
                        keys.append(restored(k, True))
                        logs.append(np.frombuffer(v, "<f4"))
                else:
                    yield from rate(*unpack_chunk(*packed), np.concatenate(keys), np.concatenate(logs), words)
                    keys, logs, words = [], [], {}

    def rate(ids, offsets, text, keys, logs, words):
        find = Lookup(keys)
        names, numbers, forms = chunk_words(offsets, text)
        own = np.r_[np.fromiter(map(_word_key, names), np.uint64, len(names)), np.array([_word_key(b"")], np.uint64)]
        distinct, back = np.unique(own, return_inverse=True)
        count = np.zeros(len(distinct), np.int64)
        for b, at in buckets.deal(distinct, buckets.of_words(distinct)):
            count[at] = words[b]
        value = np.log10(count[back.reshape(-1)] + 1.0)
        end = value[-1]
        size, total = np.zeros(len(ids), np.int64), np.zeros(len(ids))
        for a, b in _blocks(ids, offsets):
            parts = forms[a:b]
            at = find(gram_keys(parts, depth))
            lengths = np.array([len(t) for t in parts])
            size[a:b] = lengths
            total[a:b] = np.add.reduceat(logs[at].astype(np.float64), np.cumsum(lengths) - lengths)
        n = np.array([len(x) + 1 for x in numbers])
        base = np.array([value[x].sum() + end for x in numbers]) - n * log_base
        known = np.array([int((value[x] > 0).sum() + (end > 0)) for x in numbers])
        held = np.fromiter((i != NO_ID and zlib.crc32(b"%d" % i) % FOLDS == HELD_OUT for i in ids.tolist()), bool, len(ids))
        yield pa.RecordBatch.from_arrays([id_column(ids), pa.array(held), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(ids), train_tokens), pa.int64()), pa.array(base), pa.array(total), pa.array(size)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bytes"])

    return joined.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bytes long")

"""Removal of repeated substrings by prefix-free parsing.

A byte position is a trigger where the rolling hash of the `k` bytes from it is 0 mod `modulus`. Triggers cut a document into phrases: from one
trigger to the end of the next one's k bytes, so neighbours share a trigger. The distinct phrases, sorted, are the dictionary; the documents
as sequences of phrase ranks are the parse (`parse` gives both for some texts, `parse_sizes` their sizes for a corpus). A stretch of `length`
bytes without a trigger, inside one long phrase, is cut once more, at the least hash of each such string; so every string of `length` bytes has
one trigger that is its own, the first in it or the least hash, which depends on the string alone.

A string is then j bytes of a phrase, the beginning of a suffix of the dictionary that ends with the string's own trigger, and length - j bytes from the trigger on,
the beginning of a suffix of the parse. The corpus is spread by triggers: a bucket has all dictionary suffixes that end with its triggers and all
parse suffixes that begin with them.

1. Each chunk of documents sends its triggers' hashes to buckets, which answer which of them other documents hold too.
   A string with a trigger that occurs in one document only can't be repeated: most of a corpus ends here.
2. For triggers that do repeat, a chunk sends its distinct pairs of a phrase and what the parse goes on with, as far as a string reaches, each with its
   least document id. A bucket keeps pairs once each, however many chunks send them, and makes two suffix arrays: of the dictionary's phrases, read
   backwards from the trigger, and of the parse's suffixes, each with the common prefixes of neighbours. Of strings with j bytes before the trigger, those
   are equal whose ranks agree in both arrays at j and length - j bytes: the two combine to the corpus's order of the strings
   (`corpus_order` writes it out for some texts), without any string being formed. Each equal run has a least document; a bit for each pair and
   j says that it is less than the chunk's own.
3. The chunk marks the strings so found, and those that repeat one of its own earlier documents.

Nothing is decided by hashes alone: they pick triggers and buckets, and what is equal is compared byte by byte. A chunk sends
a pair once, however many copies it holds, and a bucket holds 12 bytes for each time that it gets one again, so passages shared by very many
documents stay small. There are as many buckets as chunks, so a bucket's share doesn't grow with the corpus. What moves are compressed chunks
(twice), three bytes or so per trigger, and the pairs of repeated triggers.

Defined results: a null text is empty; a text shorter than `length` loses nothing; of rows that share an id none
counts as earlier; rows without an id come after all others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import carried, fresh_worker, id_column, materialize, pack_chunks, prepare, release_shuffles, shuffle_partitions, unpack_chunk

LENGTH, K, MODULUS = 50, 18, 16
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse mod 2 ** 64."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers.clear()
        _powers[size] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in (_BASE, inverse))
    return _powers[size]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)


def rolling_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k bytes from each position on."""
    n = len(raw) - k + 1
    power, inverse = _power_tables(len(raw))
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], dtype=np.uint64, out=sums[1:])
    h = (sums[k:] - sums[:-k])[:n] * inverse[:n]
    return _mixed(h)


def cuts(h: np.ndarray, offsets: np.ndarray, k: int, modulus: int) -> tuple[np.ndarray, np.ndarray]:
    """The triggers of documents, by the hashes of their bytes: places in order, and their documents."""
    at = np.flatnonzero(h % np.uint64(modulus) == 0)
    doc = np.searchsorted(offsets, at, side="right") - 1
    inside = at + k <= offsets[doc + 1]
    return at[inside], doc[inside]


def _least(h: np.ndarray, window: int) -> np.ndarray:
    """Where the least of each window of values is, leftmost on ties."""
    least, at = (h >> np.uint64(32)).astype(np.uint32), np.arange(len(h), dtype=np.int64)
    width = 1
    while width < window:
        s = min(width, window - width)
        take = least[s:] < least[:-s]
        at = np.where(take, at[s:], at[:-s])
        least = np.where(take, least[s:], least[:-s])
        width += s
    return at


class Triggers:
    """The strings' own triggers in some documents of a chunk: place, hash, and the strings that are theirs, jmin to jmax bytes before them."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, length: int, k: int, modulus: int = MODULUS):
        none = np.empty(0, np.int64)
        self.place = self.doc = self.jmin = self.jmax = none
        self.hash = np.empty(0, np.uint64)
        if len(raw) < length:
            return
        h, reach = rolling_hashes(raw, k), length - k
        at, doc = cuts(h, offsets, k, modulus)
        begin, stop = offsets[:-1], offsets[1:] - length  # a document's first and last string
        first = np.r_[True, doc[1:] != doc[:-1]] if len(at) else np.empty(0, bool)
        after = np.where(first, begin[doc], np.r_[0, at[:-1] + 1]) if len(at) else none  # behind the trigger before
        low, high = np.maximum(after, at - reach), np.minimum(at, stop[doc])
        some = low <= high
        # Strings without a trigger: between triggers, behind a document's last one, in documents without any.
        tail = np.full(len(begin), 0) + begin
        tail[doc] = at + 1  # the last of a document's triggers stays
        a, b = np.r_[after, tail], np.r_[np.minimum(at - reach - 1, stop[doc]), stop]
        d = np.r_[doc, np.arange(len(begin))]
        a, b, d = (x[a <= b] for x in (a, b, d))
        order = np.argsort(a, kind="stable")
        a, n, d = a[order], (b - a + 1)[order], d[order]
        size = n + reach
        heads = np.cumsum(size) - size
        where = np.repeat(a - heads, size) + np.arange(int(size.sum()))
        own = where[_least(h[where], reach + 1)] if len(where) else none
        chosen = np.repeat(heads, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        own, start, owner = own[chosen] if len(chosen) else none, where[chosen], np.repeat(d, n)
        new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])]) if len(own) else none
        last = np.r_[new[1:], len(own)] - 1 if len(own) else none
        self.place, self.doc = np.r_[at[some], own[new]], np.r_[doc[some], owner[new]]
        self.jmax = np.r_[(at - low)[some], own[new] - start[new]]
        self.jmin = np.r_[(at - high)[some], own[new] - start[last]]
        self.hash = h[self.place]

    def take(self, chosen: np.ndarray) -> Triggers:
        for name in ("place", "doc", "jmin", "jmax", "hash"):
            setattr(self, name, getattr(self, name)[chosen])
        return self


def document_blocks(offsets: np.ndarray, most: int = 2 << 20):
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b
        a = b


def all_triggers(text: bytes, offsets: np.ndarray, length: int, k: int, keep=lambda h: np.ones(len(h), bool)) -> Triggers:
    """The triggers of a chunk that keep holds of; a block of documents at a time, so arrays per byte stay small."""
    raw, parts = np.frombuffer(text, np.uint8), []
    for a, b in document_blocks(offsets):
        t = Triggers(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length, k)
        t.take(keep(t.hash))
        # What stays for each trigger is small: texts with one at every byte have as many as bytes.
        t.place, t.doc, t.jmin, t.jmax = t.place + offsets[a], (t.doc + a).astype(np.int32), t.jmin.astype(np.int16), t.jmax.astype(np.int16)
        parts.append(t)
    out = parts[0] if parts else Triggers(raw, offsets, length, k)
    if len(parts) > 1:
        for name in ("place", "doc", "jmin", "jmax", "hash"):
            setattr(out, name, np.concatenate([getattr(p, name) for p in parts]))
    return out


def packed(numbers: np.ndarray, level: int = 1) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(numbers).tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """A bucket for each hash. Triggers have low hashes, so they are mixed once more."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _cut(sorted_buckets: np.ndarray):
    """(bucket, start, end) of each run."""
    heads = np.flatnonzero(np.r_[True, sorted_buckets[1:] != sorted_buckets[:-1]]) if len(sorted_buckets) else np.empty(0, np.int64)
    yield from zip(sorted_buckets[heads].tolist(), heads.tolist(), np.r_[heads[1:], len(sorted_buckets)].tolist() if len(heads) else [], strict=True)


def distinct_hashes(t: Triggers, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chunk's distinct trigger hashes in order, and whether two documents of different ids hold each."""
    order = np.argsort(t.hash, kind="stable")
    h, key = t.hash[order], keys[t.doc[order]]
    heads = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
    many = np.minimum.reduceat(key, heads) != np.maximum.reduceat(key, heads) if len(heads) else np.empty(0, bool)
    return h[heads], many


def _distinct(rows: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows once each, in order, with their least key; and for each row given which of them it is."""
    rows = np.ascontiguousarray(rows)
    order = np.argsort(rows.view(f"V{rows.shape[1]}").reshape(-1), kind="stable")
    s = rows[order]
    new = np.r_[True, (s[1:] != s[:-1]).any(axis=1)] if len(s) else np.empty(0, bool)
    heads, of = np.flatnonzero(new), np.empty(len(s), np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - 1
    return s[heads], np.minimum.reduceat(least[order], heads) if len(heads) else least, of


class Phrases:
    """The distinct phrases around a chunk's repeated triggers, in order of bucket, with their least key; of holds each trigger's phrase.

    Some triggers at a time, whose phrases are kept once each, so a run of one character, every place of which may be a trigger, is as few rows as it has phrases.
    """

    def __init__(self, t: Triggers, text: bytes, keys: np.ndarray, length: int, k: int, n: int, most: int = 1 << 17):
        before = length - k
        width = before + length
        around = sliding_window_view(np.frombuffer(bytes(before) + text + bytes(length), np.uint8), width)
        at, parts, done = np.arange(width), [], 0
        self.of = np.empty(len(t.place), np.int32)
        for a in range(0, len(t.place), most):
            here = slice(a, a + most)
            jmin, jmax = t.jmin[here, None], t.jmax[here, None]
            rows = around[t.place[here]]
            rows[(at < before - jmax) | (at >= width - jmin)] = 0
            bucket = bucket_of(t.hash[here], n).astype(">u4").view(np.uint8).reshape(-1, 4)
            rows, least, of = _distinct(np.concatenate([bucket, rows, jmin.astype(np.uint8), jmax.astype(np.uint8)], axis=1), keys[t.doc[here]])
            parts.append((rows, least))
            self.of[here] = of + done
            done += len(rows)
        rows, self.least, of = _distinct(np.concatenate([np.empty((0, width + 6), np.uint8), *(r for r, _ in parts)]), np.concatenate([np.empty(0, np.int64), *(x for _, x in parts)]))
        self.of = of[self.of] if len(of) else self.of
        self.rows, self.buckets = rows[:, 4:], np.ascontiguousarray(rows[:, :4]).view(">u4").reshape(-1).astype(np.int64)


class Gathered:
    """Rows that come piece by piece, kept once each with their least key; of each piece it keeps the places of its rows. What is held grows with distinct rows."""

    def __init__(self, width: int, most: int = 8 << 20):
        self.rows, self.least, self.pieces = np.empty((0, width), np.uint8), np.empty(0, np.int64), []
        self.new, self.bytes, self.most = [], 0, most

    def add(self, rows: np.ndarray, least: np.ndarray) -> None:
        self.new.append((rows, least))
        self.bytes += rows.nbytes
        if self.bytes > max(self.most, self.rows.nbytes):
            self.merge()

    def merge(self) -> None:
        if not self.new:
            return
        rows = np.ascontiguousarray(np.concatenate([self.rows, *(r for r, _ in self.new)]))
        least = np.concatenate([self.least, *(x for _, x in self.new)])
        order = np.argsort(rows.view(f"V{rows.shape[1]}").reshape(-1), kind="stable")
        s = rows[order]
        heads = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]).any(axis=1)]) if len(s) else np.empty(0, np.int64)
        at = np.empty(len(rows), np.int32)
        at[order] = np.repeat(np.arange(len(heads), dtype=np.int32), np.diff(np.r_[heads, len(rows)]))
        self.pieces = [at[p] for p in self.pieces]
        done = len(self.rows)
        for r, _ in self.new:
            self.pieces.append(at[done : done + len(r)])
            done += len(r)
        self.rows, self.least = s[heads], np.minimum.reduceat(least[order], heads) if len(heads) else least
        self.new, self.bytes = [], 0


def _orders(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' sorted order, and how many bytes each shares with the one before it there."""
    rows = np.ascontiguousarray(rows)
    order = np.argsort(rows.view(f"V{rows.shape[1]}").reshape(-1), kind="stable")
    s = rows[order]
    differ = s[1:] != s[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return order, np.r_[-1, common]


def _runs_of_strings(rows: np.ndarray, length: int, k: int):
    """For each j the pairs that have strings with j bytes before their trigger, in the corpus's order, and where runs of equal strings begin among them.

    A pair is a phrase's last bytes before its trigger and the parse's first bytes from it: two suffix arrays give ranks, which combine.
    """
    before = length - k
    jmin, jmax = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
    parse, common = _orders(rows[:, before : before + length])
    phrases, shared = _orders(rows[:, before - 1 :: -1] if before else rows[:, :0])
    right, left = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    for j in range(before + 1):
        chosen = np.flatnonzero((jmin <= j) & (j <= jmax))
        if not len(chosen):
            continue
        right[parse] = np.cumsum(common < length - j)
        left[phrases] = np.cumsum(shared < j) if j else 0
        key = left[chosen] * (len(rows) + 1) + right[chosen]
        order = np.argsort(key, kind="stable")
        key = key[order]
        yield j, chosen[order], np.flatnonzero(np.r_[True, key[1:] != key[:-1]])


def lowest_keys(rows: np.ndarray, least: np.ndarray, length: int, k: int) -> np.ndarray:
    """For each pair and j the least key of a document that holds the string; a pair's own where it has no string with that j."""
    out = np.repeat(least[:, None], length - k + 1, axis=1)
    for j, chosen, heads in _runs_of_strings(rows, length, k) if len(rows) else ():
        out[chosen, j] = np.repeat(np.minimum.reduceat(least[chosen], heads), np.diff(np.r_[heads, len(chosen)]))
    return out


def earlier(lowest: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each pair the bits j of the strings that a document with a key less than its own holds."""
    bits = np.uint64(1) << np.arange(lowest.shape[1], dtype=np.uint64)
    return ((lowest < least[:, None]) * bits).sum(axis=1, dtype=np.uint64)


def removed_spans(t: Triggers, p: Phrases, masks: np.ndarray, keys: np.ndarray, size: int, length: int) -> np.ndarray:
    """Which bytes of a chunk's text are covered by strings to remove."""
    mask, own, begins = masks[p.of], keys[t.doc] > p.least[p.of], np.zeros(size, bool)
    for j in range(int(t.jmax.max()) + 1 if len(t.jmax) else 0):
        hit = (t.jmin <= j) & (j <= t.jmax) & (own | ((mask >> np.uint64(j)) & np.uint64(1)).astype(bool))
        begins[t.place[hit] - j] = True
    begun = np.cumsum(begins, dtype=np.int32)  # strings never leave their document
    begun[length:] -= begun[:-length].copy()
    return begun > 0


def whole_characters(gone: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """gone, without the characters of which not all bytes are gone."""
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    if not len(starts) or starts[0]:
        starts = np.r_[0, starts]
    return np.repeat(np.logical_and.reduceat(gone, starts), np.diff(np.r_[starts, len(raw)])) if len(raw) else gone


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, chunk_bytes: int = 8 << 20, with_spans: bool = False, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    with_spans adds span_starts and span_ends (byte offsets); with_text adds text, what is kept, where a character stays unless
    all its bytes go; carry adds other columns of docs.
    """
    spark = docs.sparkSession
    prepare(spark)
    n = shuffle_partitions(spark)
    chunks, _ = materialize(pack_chunks(docs, chunk_bytes, carry, level=5), "repeat-chunks")
    buckets = max(2 * n, chunks.count())  # of a written table

    def send(batches):
        fresh_worker()
        for batch in batches:
            for chunk, *body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, offsets, text = unpack_chunk(*body)
                h, many = distinct_hashes(all_triggers(text, offsets, length, k), ids)
                order = np.argsort(bucket_of(h, buckets), kind="stable")
                h, many = h[order], many[order]
                rows = [(b, chunk, packed((h[s:e] & np.uint64(0xFFFFFFFF)).astype("<u4")), packed(many[s:e])) for b, s, e in _cut(bucket_of(h, buckets))]
                for a in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 64], strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "chunk_id", "hashes", "many"])

    def grouped(batches, work):
        """Calls work(bucket, rows) for the rows of each bucket, which come in order."""
        fresh_worker()
        held, now = [], None
        for batch in batches:
            for b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != now and held:
                    yield from work(now, held)
                    held = []
                now = b
                held.append(row)
        if held:
            yield from work(now, held)

    def compare(batches):
        def work(b, rows):
            parts = [unpacked(h, "<u4") for _, h, _ in rows]
            h = np.concatenate(parts)
            order = np.argsort(h, kind="stable")
            s = h[order]
            same = np.zeros(len(s), bool)
            same[1:] = s[1:] == s[:-1]
            same[:-1] |= s[1:] == s[:-1]
            again = np.empty(len(s), bool)
            again[order] = same
            again |= np.concatenate([unpacked(m, bool) for _, _, m in rows])
            at = 0
            out = []
            for (chunk, _, _), part in zip(rows, parts, strict=True):
                if (chosen := part[again[at : at + len(part)]]).size:
                    out.append((chunk, b, packed(np.sort(chosen))))
                at += len(part)
            for a in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[a : a + 64], strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["chunk_id", "bucket", "data"])

        return grouped(batches, work)

    hashes = chunks.mapInArrow(send, "bucket int, chunk_id long, hashes binary, many binary").repartition(n, "bucket").sortWithinPartitions("bucket")
    repeated, _ = materialize(hashes.mapInArrow(compare, "chunk_id long, bucket int, data binary"), "repeat-triggers")
    del hashes
    release_shuffles(spark)

    def with_bodies(*answers: tuple[int, DataFrame]) -> DataFrame:
        """Each chunk's rows in order: answers of each kind by bucket, then its body."""
        none = [F.lit(None).cast("binary").alias(c) for c in ("doc_ids", "lengths", "body", "rest")]
        out = chunks.select("chunk_id", F.lit(9).alias("kind"), F.lit(0).alias("bucket"), F.lit(None).cast("binary").alias("data"), "doc_ids", "lengths", "body", "rest")
        for kind, df in answers:
            out = out.unionByName(df.select("chunk_id", F.lit(kind).alias("kind"), "bucket", "data", *none))
        return out.repartition(n, "chunk_id").sortWithinPartitions("chunk_id", "kind", "bucket")

    def bodies(batches):
        """(chunk, ids, offsets, text, {kind: {bucket: data}, "rest": the columns carried})"""
        fresh_worker()
        held: dict = {}
        for batch in batches:
            for chunk, kind, bucket, data, *body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 9:
                    yield chunk, *unpack_chunk(*body), held | {"rest": body[3]}
                    held = {}
                else:
                    held.setdefault(kind, {})[bucket] = data

    def parsed(ids, offsets, text, wanted: dict) -> tuple[Triggers, Phrases]:
        names = [np.uint64(b) << np.uint64(32) | unpacked(x, "<u4").astype(np.uint64) for b, x in sorted(wanted.items())]
        known = np.concatenate(names) if names else np.empty(0, np.uint64)

        def keep(h):
            if not len(known):
                return np.zeros(len(h), bool)
            name = bucket_of(h, buckets).astype(np.uint64) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))
            return known[np.minimum(np.searchsorted(known, name), len(known) - 1)] == name

        t = all_triggers(text, offsets, length, k, keep)
        return t, Phrases(t, text, ids, length, k, buckets)

    def phrases(batches):
        for chunk, ids, offsets, text, held in bodies(batches):
            _, p = parsed(ids, offsets, text, held.get(0, {}))
            rows = [(b, chunk, packed(p.rows[s:e], 5), packed(p.least[s:e])) for b, s, e in _cut(p.buckets)]
            for a in range(0, len(rows), 16):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 16], strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "chunk_id", "rows", "least"])

    def combine(batches):
        fresh_worker()
        width = 2 * length - k + 2
        now, who, keys, held = None, [], [], None

        def out():
            held.merge()
            lowest, rows = lowest_keys(held.rows, held.least, length, k), []
            for chunk, key, at in zip(who, keys, held.pieces, strict=True):
                own = unpacked(key, "<i8")
                rows.append((chunk, now, packed(np.concatenate([earlier(lowest[at[a : a + 65_536]], own[a : a + 65_536]) for a in range(0, len(own), 65_536)]))))
                if len(rows) == 64:
                    yield rows
                    rows = []
            if rows:
                yield rows

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["chunk_id", "bucket", "data"])

        for batch in batches:
            for b, chunk, rows, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != now:
                    if held:
                        yield from map(batch_of, out())
                    now, who, keys, held = b, [], [], Gathered(width)
                who.append(chunk)
                keys.append(key)
                held.add(unpacked(rows, np.uint8).reshape(-1, width), unpacked(key, "<i8"))
        if held:
            yield from map(batch_of, out())

    dealt = with_bodies((0, repeated)).mapInArrow(phrases, "bucket int, chunk_id long, rows binary, least binary").repartition(n, "bucket").sortWithinPartitions("bucket")
    masks, _ = materialize(dealt.mapInArrow(combine, "chunk_id long, bucket int, data binary"), "repeat-masks")
    del dealt
    release_shuffles(spark)

    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[docs[c] for c in carry]).schema)
    names = [x.split()[0] for x in RESULT.split(", ")] + ["span_starts", "span_ends"] * with_spans + ["text"] * with_text
    schema = RESULT + ", span_starts array<long>, span_ends array<long>" * with_spans + ", text string" * with_text + extra

    def finish(batches):
        for _, ids, offsets, text, held in bodies(batches):
            t, p = parsed(ids, offsets, text, held.get(0, {}))
            masks = [unpacked(x, "<u8") for _, x in sorted(held.get(1, {}).items())]
            gone = removed_spans(t, p, np.concatenate(masks) if masks else np.empty(0, np.uint64), ids, len(text), length)
            raw, rows = np.frombuffer(text, np.uint8), []
            rest = carried(held["rest"]).combine_chunks() if carry else None
            for i, a, b in zip(ids.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                g = gone[a:b]
                turns = np.flatnonzero(np.diff(np.r_[False, g, False].astype(np.int8)))
                kept = text[a:b] if not len(turns) else raw[a:b][~g].tobytes()
                row = [i, b - a, int(g.sum()), len(turns) // 2, hashlib.sha256(kept).hexdigest()]
                if with_spans:
                    row += [turns[::2].tolist(), turns[1::2].tolist()]
                if with_text:
                    row.append((raw[a:b][~whole_characters(g, raw[a:b])].tobytes() if len(turns) else kept).decode("utf-8", "surrogatepass"))
                rows.append(row)
            for a in range(0, len(rows), 500):
                columns = list(zip(*rows[a : a + 500], strict=True))
                kinds = [None, pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.list_(pa.int64())] * 2 * with_spans + [pa.string()] * with_text
                yield pa.RecordBatch.from_arrays([id_column(np.array(columns[0], np.int64)), *[pa.array(c, t) for c, t in zip(columns[1:], kinds[1:], strict=True)], *([x.combine_chunks() for x in rest.slice(a, 500).columns] if carry else [])], names + list(carry))

    return with_bodies((0, repeated), (1, masks)).mapInArrow(finish, schema)


# The parse itself


def parse(texts: list[bytes], k: int = K, modulus: int = MODULUS) -> tuple[list[bytes], list[np.ndarray]]:
    """The dictionary, distinct phrases in order, and the parse, each text's phrases by rank. Texts come back by joining phrases without the k bytes shared with the one before."""
    split = []
    for t in texts:
        raw = np.frombuffer(t, np.uint8)
        at = cuts(rolling_hashes(raw, k), np.array([0, len(t)]), k, modulus)[0] if len(t) >= k else np.empty(0, np.int64)
        inner = at[at > 0].tolist()
        split.append([t[a : b + k] for a, b in zip([0, *inner], [*inner, len(t)], strict=True)])
    dictionary = sorted({p for phrases in split for p in phrases})
    rank = {p: r for r, p in enumerate(dictionary)}
    return dictionary, [np.array([rank[p] for p in phrases], np.int64) for phrases in split]


def corpus_order(texts: list[bytes], length: int = LENGTH, k: int = K) -> list[list[tuple[int, int]]]:
    """The strings of `length` bytes of some texts as runs of equal ones, each a list of (text, place): what buckets derive, for as much as one call holds."""
    offsets = np.cumsum([0, *map(len, texts)])
    t = all_triggers(b"".join(texts), offsets, length, k)
    p = Phrases(t, b"".join(texts), np.arange(len(texts)), length, k, 1)
    holders: dict[int, list[int]] = {}
    for i, row in enumerate(p.of.tolist()):
        holders.setdefault(row, []).append(i)
    out = []
    for j, chosen, heads in _runs_of_strings(p.rows, length, k):
        for run in np.split(chosen, heads[1:]):
            out.append(sorted((int(t.doc[i]), int(t.place[i] - j - offsets[t.doc[i]])) for row in run.tolist() for i in holders[row]))
    return out


def parse_sizes(docs: DataFrame, k: int = K, modulus: int = MODULUS) -> DataFrame:
    """One row: phrases (distinct ones of the whole corpus, by 64-bit hash) and parse_length (all of them)."""
    prepare(docs.sparkSession)

    def count(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            dictionary, ranks = parse([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(0).to_pylist()], k, modulus)
            times = np.bincount(np.concatenate([np.empty(0, np.int64), *ranks]), minlength=len(dictionary))
            names = np.array([xxh64_intdigest(p) for p in dictionary], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(times)], ["phrase", "times"])

    rows = docs.select(docs["text"].cast("string").alias("text")).mapInArrow(count, "phrase long, times long")
    return rows.groupBy("phrase").agg(F.sum("times").alias("times")).agg(F.count("*").alias("phrases"), F.coalesce(F.sum("times"), F.lit(0)).alias("parse_length"))

"""Embedding near-duplicates by spherical-cap filters from a structured random product code.

Vectors are turned by a random rotation and cut in two halves; each half has B random directions, and every pair of
directions is a filter, B * B in all. A vector belongs to the filters whose inner product with it exceeds a threshold;
list decoding finds exactly these: with both halves' scores sorted, only pairs that can exceed it are visited. B grows
with the square root of the number of vectors, so a filter holds about `per_filter` vectors at any size, and the threshold is
fitted on at most `sample` vectors so that a vector has about `filters` filters; one with fewer than `least` lowers its own.
All vectors are filed, and all pairs within a filter are verified by their cosine in double precision.

Equal vectors are merged first and count with their number. Filters that share their first direction, and their second one's range of
`seconds` neighbours, are a cell, which one task gets: it holds some seconds * per_filter vectors at any size of the table, and a vector goes to no more
cells than it has filters. Cells with more than `most` vectors, as a crowd of alike vectors makes them, are cut into parts by hash, every two of which meet in a task. A pair is
counted in the least filter that holds both, so it counts once without being written anywhere: tasks return each
vector's number of links and a spanning forest of the links, never the pairs of a group.

A pair at cosine 0.95 exactly shares no filter with a probability of about (1 - p) ** filters, with p the chance of one
filter, 0.4 to 0.6: below 1e-6 with the defaults. Tests measure recall against brute force.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component has no links and is its own
component; vectors of different lengths never link; a null vec_id is no component's name unless all members' are null (kept
is then false); rows that share an id each have their row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, prepare, shuffle_partitions
from .components import named
from .simhash import dealt, merge_labels

VECTORS = "key long, n long, least long, dim int, body binary"


class ProductCode:
    """The filters: two halves of `size` unit directions under a random rotation, for vectors of `dim` components."""

    def __init__(self, dim: int, size: int, seed: int):
        rng = np.random.default_rng([seed, dim, size])
        self.dim, self.size, self.threshold = dim, size, 0.0
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        half = dim // 2
        self.halves = [c / np.linalg.norm(c, axis=1, keepdims=True) for c in (rng.standard_normal((size, half)), rng.standard_normal((size, dim - half)))]

    def scores(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, half = unit @ self.turn, self.dim // 2
        return x[:, :half] @ self.halves[0].T, x[:, half:] @ self.halves[1].T

    def fit(self, unit: np.ndarray, filters: int) -> None:
        """Set the threshold at which these vectors have `filters` filters on average."""
        low, high = 0.0, 2.0
        a, b = (np.sort(s, axis=1) for s in self.scores(unit))
        for _ in range(18):
            self.threshold = (low + high) / 2
            n = sum(int((len(y) - np.searchsorted(y, self.threshold - x)).sum()) for x, y in zip(a, b, strict=True))
            low, high = (self.threshold, high) if n > filters * len(unit) else (low, self.threshold)
        self.threshold = low

    def decode(self, unit: np.ndarray, least: int) -> list[np.ndarray]:
        """The sorted filters of each vector: first direction * size + second direction."""
        out = []
        for s, t in zip(*self.scores(unit), strict=True):
            i, j = np.argsort(-s), np.argsort(-t)
            s, t, limit = s[i], -t[j], self.threshold
            while True:
                top = int(np.searchsorted(-s, t[0] * -1 - limit, side="right"))  # s + max t reaches the limit
                n = np.searchsorted(t, s[:top] - limit, side="right")
                if n.sum() >= min(least, self.size**2):
                    break
                limit -= 0.02
            first = np.repeat(i[:top], n)
            second = j[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            out.append(np.sort(first.astype(np.int64) * self.size + second))
        return out


def unit_rows(bodies: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(bodies), "<f8").reshape(-1, dim)
    # Scaled by the largest component first, so no square over- or underflows.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.pad(x, ((0, 0), (0, max(0, 8 - dim)))) if dim < 8 else x


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """Valid vectors made distinct: key, number of rows, least vec_id, components as doubles."""
    v = F.col("embedding")
    valid = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    grouped = vectors.where(valid).groupBy("embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))

    def pack(batches):
        for batch in batches:
            bodies = [np.array(x, "<f8").tobytes() for x in batch.column("embedding").to_pylist()]
            dims = pa.array([len(b) // 8 for b in bodies], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), batch.column("least"), dims, pa.array(bodies, pa.binary())], ["key", "n", "least", "dim", "body"])

    return grouped.select(F.monotonically_increasing_id().alias("key"), "n", "least", "embedding").mapInArrow(pack, VECTORS)


class Group:
    """Vectors of a first direction: verifies the pairs of each filter and keeps counts and a forest."""

    def __init__(self, unit, weight, part, lists, p: int, q: int, cosine: float):
        self.unit, self.weight, self.part, self.lists = unit, weight, part, lists
        self.p, self.q, self.cosine = p, q, cosine
        self.count, self.labels = np.zeros(len(unit), np.int64), np.arange(len(unit))

    def wanted(self, i, j):
        """Pairs of a task of two parts are those between the parts."""
        return self.part[i] != self.part[j] if self.p != self.q else np.ones(np.broadcast_shapes(i.shape, j.shape), bool)

    def add(self, i, j):
        np.add.at(self.count, i, self.weight[j])
        np.add.at(self.count, j, self.weight[i])
        self.labels = merge_labels(self.labels, i, j)

    def small(self, filters, i, j):
        """Pairs i, j of the filters of the same position."""
        for a in range(0, len(i), 20_000):
            x, y, f = i[a : a + 20_000], j[a : a + 20_000], filters[a : a + 20_000]
            near = (np.einsum("ij,ij->i", self.unit[x], self.unit[y]) >= self.cosine) & self.wanted(x, y)
            x, y, f = x[near], y[near], f[near]
            first = np.fromiter((np.intersect1d(self.lists[u], self.lists[v], assume_unique=True)[0] == w for u, v, w in zip(x, y, f, strict=True)), bool, len(x))
            self.add(x[first], y[first])

    def large(self, f: int, members: np.ndarray, step: int = 512, wide: int = 4096):
        """All pairs of a filter with many vectors, a block of the product at a time; whether a pair shares a lesser filter, for `wide` filters at a time."""
        blocks = [members[a : a + step] for a in range(0, len(members), step)]
        before = [[x[: np.searchsorted(x, f)] for x in (self.lists[m] for m in block)] for block in blocks]
        names = [np.unique(np.concatenate(x)) for x in before]

        def inside(k: int, chosen: np.ndarray) -> np.ndarray:
            out = np.zeros((len(blocks[k]), len(chosen)), np.float32)
            for row, x in zip(out, before[k], strict=True):
                at = np.searchsorted(chosen, x)
                row[at[(at < len(chosen)) & (chosen[np.minimum(at, len(chosen) - 1)] == x)]] = 1
            return out

        for a, x in enumerate(blocks):
            for b in range(a, len(blocks)):
                y = blocks[b]
                near = (self.unit[x] @ self.unit[y].T >= self.cosine) & self.wanted(x[:, None], y[None, :])
                if a == b:
                    near = np.triu(near, 1)
                common = np.intersect1d(names[a], names[b], assume_unique=True) if near.any() else ()
                for c in range(0, len(common), wide):
                    near &= inside(a, common[c : c + wide]) @ inside(b, common[c : c + wide]).T == 0
                self.count[x] += near @ self.weight[y]
                self.count[y] += self.weight[x] @ near
                i, j = np.nonzero(near)
                self.labels = merge_labels(self.labels, x[i], y[j])

    def run(self, low: int, high: int, few: int = 64):
        """The filters from low up to high."""
        lists = [x[np.searchsorted(x, low) : np.searchsorted(x, high)] for x in self.lists]
        filters = np.concatenate(lists)
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.argsort(filters, kind="stable")
        filters, owner = filters[order], owner[order]
        heads = np.flatnonzero(np.r_[True, filters[1:] != filters[:-1]])
        sizes = np.diff(np.r_[heads, len(filters)])
        for h, n in zip(heads[sizes > few], sizes[sizes > few], strict=True):
            self.large(int(filters[h]), owner[h : h + n])
        for n in np.unique(sizes[(sizes > 1) & (sizes <= few)]):
            h = heads[sizes == n]
            i, j = np.triu_indices(n, 1)
            for a in range(0, len(h), max(1, 200_000 // len(i))):
                k = h[a : a + max(1, 200_000 // len(i))]
                self.small(np.repeat(filters[k], len(i)), owner[(k[:, None] + i).ravel()], owner[(k[:, None] + j).ravel()])
        return self


def linked(distinct: DataFrame, cosine: float, filters: int, least: int, per_filter: int, sample: int, most: int, seed: int, seconds: int) -> DataFrame:
    """(a, b, n): links found. b null: vector a has n links to rows of other vectors in some task; else a and b are connected."""
    spark = distinct.sparkSession
    made: list[ProductCode] = []
    for r in distinct.groupBy("dim").count().collect():  # one row per length of vectors
        code = ProductCode(max(r.dim, 8), max(4, int(np.ceil(np.sqrt(filters * r["count"] / per_filter)))), seed)
        chosen = distinct.where(F.col("dim") == r.dim).orderBy(F.xxhash64("key", F.lit(seed))).limit(sample).select("body").collect()
        code.fit(unit_rows([bytes(x.body) for x in chosen], r.dim), filters)
        made.append((r.dim, code))
    codes = spark.sparkContext.broadcast(dict(made))  # dim * B numbers, B the root of the number of vectors

    def filed(batches):
        """(batch's rows, their dim, unit vectors, filters)"""
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                rows = batch.filter(pa.array(dims == d))
                yield rows, int(d), codes.value[d].decode(unit_rows(rows.column("body").to_pylist(), int(d)), least)

    def cells(x: np.ndarray, size: int) -> np.ndarray:
        """The cells of sorted filters: first direction, then the range of the second."""
        return np.unique(x // size * -(-size // seconds) + x % size // seconds)

    def deal(batches):
        for rows, d, lists in filed(batches):
            found = [cells(x, codes.value[d].size) for x in lists]
            again = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            bodies = pa.array([x.tobytes() for x in lists], pa.binary())
            for a in range(0, len(again), 2000):
                at = again.slice(a, 2000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), d), pa.int32()), pa.array(np.concatenate(found)[a : a + 2000]), *[rows.column(c).take(at) for c in ("key", "n", "body")], bodies.take(at)], ["turn", "root", "key", "n", "body", "filters"])

    def verify(batches):
        held: list[pa.RecordBatch] = []

        def out(key):
            t = pa.Table.from_batches(held)
            d, cell, p, q = key
            size, each = codes.value[d].size, -(-codes.value[d].size // seconds)
            low = cell // each * size + cell % each * seconds
            high = min(low + seconds, (cell // each + 1) * size)
            lists = [np.frombuffer(x, np.int64) for x in t["filters"].to_pylist()]
            g = Group(unit_rows(t["body"].to_pylist(), d), t["n"].to_numpy(), t["part"].to_numpy(), lists, p, q, cosine).run(low, high)
            keys = t["key"].to_numpy()
            some, other = np.flatnonzero(g.count), np.flatnonzero(g.labels != np.arange(len(keys)))
            a, b = np.r_[keys[some], keys[other]], np.r_[np.zeros(len(some), np.int64), keys[g.labels[other]]]
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=np.arange(len(a)) < len(some)), pa.array(np.r_[g.count[some], np.zeros(len(other), np.int64)])], ["a", "b", "n"])

        now = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("turn", "root", "p", "q")], axis=1).astype(np.int64)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if (key := tuple(keys[a].tolist())) != now and held:
                    yield out(now)
                    held = []
                now = key
                held.append(batch.slice(a, b - a))
        if held:
            yield out(now)

    filed_ = distinct.mapInArrow(deal, "turn int, root long, key long, n long, body binary, filters binary")
    return dealt(filed_, "key", most, with_part=True).mapInArrow(verify, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, filters: int = 32, least: int = 16, per_filter: int = 16, sample: int = 1000, most: int = 20_000, seed: int = 11, seconds: int = 1024) -> DataFrame:
    """One row per vector row: vec_id, n_links, component_id, kept."""
    prepare(vectors.sparkSession)
    vectors = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("embedding"))
    distinct, _ = materialize(distinct_vectors(vectors), "vectors")
    found, _ = materialize(linked(distinct, cosine, filters, least, per_filter, sample, most, seed, seconds), "vector-links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("others"))
    d = named(distinct.drop("dim"), found.where("b IS NOT NULL"), "key").join(counts, "key", "left")

    def unpack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.frombuffer(x, "<f8").tolist() for x in batch.column("body").to_pylist()], pa.list_(pa.float64())), batch.column("links"), batch.column("component_id")], ["_v", "links", "component_id"])

    placed = d.select("body", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"), "component_id").mapInArrow(unpack, "_v array<double>, links long, component_id long")
    out = vectors.join(placed, F.col("embedding") == F.col("_v"), "left")
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))

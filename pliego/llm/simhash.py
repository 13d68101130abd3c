"""SimHash near-duplicates: fingerprints of word shingles, linked by a binary trie joined with itself.

Fingerprints are made distinct first, so copies cost nothing more. Two fingerprints within k bits agree on one of k + 1
blocks of bits at least (or on two of k + 2, and so on); the values of blocks root tries over the bits turned so that these
blocks come first. A task walks
pairs of nodes at equal depth together: a node with itself, then with its sibling at one differing bit, adding up
differing bits and leaving a pair once they exceed k. Small pairs of nodes are compared at once. A task returns a
spanning forest of the links that it finds, never all pairs of a group; the forests' components are the links' components.
A root with more than `most` fingerprints is cut into parts by hash, and every two parts meet in a task of their own.

Defined results: a null or empty text has fingerprint zero and links like any other; rows that share an id each have
their row; a null id is no component's name unless all members' ids are null; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import doc_columns, fresh_worker, materialize, prepare, release_shuffles, remove, shuffle_partitions
from .components import components, named


def _spread() -> np.ndarray:
    """For each byte a number whose eight bytes are its bits, lowest first."""
    b = np.arange(256, dtype=np.uint64)
    return sum(((b >> np.uint64(j)) & np.uint64(1)) << np.uint64(8 * j) for j in range(8))


def shingle_hashes(text: str | None, size: int, seed: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    if len(words) <= size:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    starts = [0, *ends[:-size].tolist()]
    return np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray, spread: np.ndarray) -> int:
    """A bit is set if it is in over half the hashes. Bits are counted in bytes of sums over up to 255 hashes."""
    if not len(hashes):
        return 0
    sums = np.add.reduceat(spread[hashes.view(np.uint8).reshape(-1, 8)], np.arange(0, len(hashes), 255), axis=0)
    counts = sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a long."""
    prepare(docs.sparkSession)

    def make(batches):
        fresh_worker()
        spread = _spread()
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t, shingle, seed), spread) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return doc_columns(docs).mapInArrow(make, "doc_id long, fp long")


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (the least index of each) after adding edges a-b."""
    while len(a):
        x, y = labels[a], labels[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        open_ = low != high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(labels, high[open_], low[open_])
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels


def trie_links(values: np.ndarray, depth: int, k: int, block: int = 1 << 16, small: int = 64, other: np.ndarray | None = None, total: int = 128) -> np.ndarray:
    """values: sorted distinct uint64. Labels of components under links of at most k differing bits between values that agree on the first depth bits.

    With further fingerprints in the columns of `other`, values may repeat, equal ones are linked, and a link has at most `total` differing bits in all.
    """
    labels = np.arange(len(values)) if other is None else np.searchsorted(values, values)
    heads = np.flatnonzero(np.r_[True, (values[1:] >> np.uint64(64 - depth)) != (values[:-1] >> np.uint64(64 - depth))]) if len(values) else np.empty(0, int)
    tails = np.r_[heads[1:], len(values)]
    many = tails - heads > 1
    zero = np.zeros(int(many.sum()), np.int64)
    stack = [(depth, heads[many], tails[many], heads[many], tails[many], zero)]
    while stack:
        d, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > block:
            half = len(a0) // 2
            stack += [(d, *(x[:half] for x in (a0, a1, b0, b1, err))), (d, *(x[half:] for x in (a0, a1, b0, b1, err)))]
            continue
        # Nodes whose values are all in one component have nothing to add.
        changes = np.r_[0, np.cumsum(labels[1:] != labels[:-1])] if len(labels) else labels
        done = (changes[a0] == changes[a1 - 1]) & (changes[b0] == changes[b1 - 1]) & (labels[a0] == labels[b0])
        product = (a1 - a0) * (b1 - b0)
        now = ~done & ((product <= small) | (d == 64))
        if now.any():
            n = product[now]
            which = np.repeat(np.flatnonzero(now), n)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            width = (b1 - b0)[which]
            i, j = a0[which] + nth // width, b0[which] + nth % width
            bits = np.bitwise_count(values[i] ^ values[j])
            near = (i < j) & (bits <= k)
            if other is not None:
                near &= bits + np.bitwise_count(other[i] ^ other[j]).sum(axis=1, dtype=np.int64) <= total
            labels = merge_labels(labels, i[near], j[near])
        go = ~done & ~now
        if not go.any():
            continue
        a0, a1, b0, b1, err = (x[go] for x in (a0, a1, b0, b1, err))
        bit, kept = np.uint64(1 << (63 - d)), np.uint64((1 << 64) - (1 << (64 - d)))
        split = lambda s: np.searchsorted(values, (values[s] & kept) | bit)
        am, bm, same = np.minimum(np.maximum(split(a0), a0), a1), np.minimum(np.maximum(split(b0), b0), b1), a0 == b0
        sides = [(a0, am, b0, bm, err, None), (am, a1, bm, b1, err, None), (a0, am, bm, b1, err + 1, None), (am, a1, b0, bm, err + 1, ~same)]
        parts = []
        for x0, x1, y0, y1, e, only in sides:
            ok = (x0 < x1) & (y0 < y1) & (e <= k)
            ok = ok if only is None else ok & only
            parts.append([x[ok] for x in (x0, x1, y0, y1, e)])
        merged = [np.concatenate(x) for x in zip(*parts, strict=True)]
        if len(merged[0]):
            stack.append((d + 1, *merged))
    return labels


def tables(k: int, blocks: int) -> list[list[tuple[int, int]]]:
    """For each choice of blocks - k of the blocks of bits, their (start, end), then those of the others."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    return [[*chosen, *(x for x in spans if x not in chosen)] for chosen in map(list, combinations(spans, blocks - k))]


def turned(fps: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """The fingerprints with their bits in the order of the spans; bit 0 is the highest."""
    out = np.zeros(len(fps), np.uint64)
    for a, b in spans:
        out = (out << np.uint64(b - a)) | ((fps >> np.uint64(64 - b)) & np.uint64((1 << (b - a)) - 1))
    return out


def blocks_for(n: int, k: int, per_root: int = 1024) -> int:
    """The fewest blocks of bits for which n fingerprints make roots of about per_root: any number above k finds all links."""
    blocks = k + 1
    while blocks < 64 and n > per_root * 2.0 ** (64 * (blocks - k) // blocks):
        blocks += 1
    return blocks


def dealt(rooted: DataFrame, key: str, most: int, with_part: bool = False) -> DataFrame:
    """Rows with turn and root, dealt by pairs of parts (p, q) of a root: one part for up to `most` rows. A part goes by the hash of key."""
    others = [c for c in rooted.columns if c not in ("turn", "root")]
    large, _ = materialize(rooted.groupBy("turn", "root").agg(F.count("*").alias("n")).where(F.col("n") > most).select("turn", "root", F.ceil(F.col("n") / most).alias("parts")), "large-roots")
    parts = F.coalesce("parts", F.lit(1)).cast("long")
    rooted = rooted.join(large, ["turn", "root"], "left").withColumn("part", F.pmod(F.xxhash64(key), parts))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda j: F.struct(F.least(j, F.col("part")).alias("p"), F.greatest(j, F.col("part")).alias("q")))
    out = rooted.select("turn", "root", *others, "part", F.explode(pairs).alias("x")).select("turn", "root", "x.p", "x.q", *others, *["part"] * with_part)
    return out.repartition(shuffle_partitions(rooted.sparkSession), "turn", "root", "p", "q").sortWithinPartitions("turn", "root", "p", "q")


def _joined(given: DataFrame, spanning, held_rows: int = 200_000) -> DataFrame:
    """Edges (a, b) that spanning(turn, table) gives for the rows of each turn and pair of parts, which a task takes in runs of about held_rows."""
    keys = ("turn", "root", "p", "q")

    def join(batches):
        fresh_worker()
        held, rows, last = [], 0, None

        def out():
            table = pa.Table.from_batches(held).combine_chunks()
            turn, p = table["turn"].to_numpy(), np.stack([table["p"].to_numpy(), table["q"].to_numpy()])
            # Groups of one turn and pair of parts share a forest, whose roots tell them apart.
            cuts = [0, *(np.flatnonzero((turn[1:] != turn[:-1]) | (p[:, 1:] != p[:, :-1]).any(axis=0)) + 1).tolist(), len(turn)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                a, b = spanning(int(turn[x]), table.slice(x, y - x))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if rows > held_rows and tuple(batch[c][0].as_py() for c in keys) != last:
                yield from out()
                held, rows = [], 0
            elif rows > held_rows:
                # A batch may end a group that the rows held began.
                same = np.all([batch[c].to_numpy() == v for c, v in zip(keys, last, strict=True)], axis=0)
                if (n := int(same.sum())) < batch.num_rows:
                    held.append(batch.slice(0, n))
                    yield from out()
                    held, rows, batch = [], 0, batch.slice(n)
            held.append(batch)
            rows += batch.num_rows
            last = tuple(batch[c][batch.num_rows - 1].as_py() for c in keys)
        if held:
            yield from out()

    return given.mapInArrow(join, "a long, b long")


def links(distinct: DataFrame, k: int = 3, blocks: int | None = None, most: int = 20_000) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints fp that span all links of at most k differing bits.

    With `blocks` blocks of bits (as many as the number of fingerprints wants by default), two linked fingerprints agree on blocks - k of
    them: a trie is rooted for each choice of so many, so more blocks mean more copies of each fingerprint and fewer to a root.
    """
    prepare(distinct.sparkSession)
    blocks = blocks or blocks_for(distinct.count(), k)
    chosen, orders = blocks - k, tables(k, blocks)

    def value(spans):
        out = F.lit(0).cast("long")
        for a, b in spans:
            out = F.shiftleft(out, b - a).bitwiseOR(F.shiftrightunsigned(F.col("fp"), 64 - b).bitwiseAND(F.lit((1 << (b - a)) - 1)))
        return out

    rooted = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("turn"), value(spans[:chosen]).alias("root")) for i, spans in enumerate(orders)])).alias("x")).select("fp", "x.turn", "x.root")

    def spanning(turn: int, table: pa.Table):
        fps = np.unique(table["fp"].to_numpy().view(np.uint64))
        values = turned(fps, orders[turn])
        order = np.argsort(values)
        labels = trie_links(values[order], sum(e - s for s, e in orders[turn][:chosen]), k)
        other = np.flatnonzero(labels != np.arange(len(labels)))
        return fps[order[other]].view(np.int64), fps[order[labels[other]]].view(np.int64)

    return _joined(dealt(rooted, "fp", most), spanning)


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, k: int = 3, blocks: int | None = None) -> DataFrame:
    """One row per document row: doc_id, fp (long), component_id (the least doc_id that links reach), root (the least fingerprint)."""
    made, _ = materialize(fingerprints(docs, shingle, seed), "simhash")
    distinct, _ = materialize(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    names, _ = materialize(named(distinct, links(distinct, k, blocks), "fp").select("fp", "component_id", "root"), "simhash-names")
    return made.join(names, "fp").select("doc_id", "fp", "component_id", "root")


def one_of_each(docs: DataFrame, shingle: int = 3, seed: int = 42, k: int = 3, blocks: int | None = None) -> DataFrame:
    """docs with one row of each group of near-duplicates, that of the least doc_id; all columns stay.

    Where several rows could be it, as rows repeat an id or have none, the first by text stays.
    """
    found, _ = materialize(near_duplicates(docs, shingle, seed, k, blocks), "simhash-groups")
    spread = _spread()
    return _first_of_each(docs, found, lambda t: fingerprint(shingle_hashes(t, shingle, seed), spread))


def one_of_each_similar(docs: DataFrame, shingle: int = 5, seed: int = 42, least: float = 0.8, **options) -> DataFrame:
    """docs with one row of each group of similar_groups, chosen as one_of_each does; all columns stay."""
    found, _ = materialize(similar_groups(docs, shingle, seed, least, **options), "similar-groups")
    return _first_of_each(docs, found, lambda t: set_number(np.unique(shingle_hashes(t, shingle, seed))))


def _first_of_each(docs: DataFrame, found: DataFrame, number) -> DataFrame:
    """found: doc_id, fp, component_id and root of each row of docs, fp being what number() gives for its text."""
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    sole = first.groupBy("root").agg(F.count("*").alias("n"), F.min("doc_id").alias("_id"))
    out = docs.join(sole.where("n = 1 AND _id IS NOT NULL"), docs["doc_id"] == F.col("_id"), "left_semi")
    several = sole.where("n > 1 OR _id IS NULL")
    if several.isEmpty():
        return out
    held = first.join(several.select("root"), "root")
    ids = held.select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.join(ids, docs["doc_id"].eqNullSafe(F.col("_id")), "left_semi")
    columns, at = docs.columns, docs.columns.index("text")

    def marked(batches):
        for batch in batches:
            fps = np.array([number(t) for t in batch.column(at).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], [*columns, "_fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", _fp long"
    groups = held.select(F.col("fp").alias("_fp"), "root").distinct().withColumnRenamed("root", "_root")
    again = rows.mapInArrow(marked, schema).join(groups, "_fp")
    # A combining minimum, so that a group of very many rows is no single task's work.
    least = again.groupBy("_root").agg(F.min_by(F.struct(*columns), F.struct(F.col("doc_id").isNull().alias("a"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))).alias("row"))
    return out.unionByName(least.select("row.*"))


# Groups by the shingles themselves


def set_number(shingles: np.ndarray) -> int:
    """A number for a set of shingles, given as their sorted distinct hashes."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(shingles.tobytes())


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Other hashes made of these, for a second fingerprint (the finaliser of splitmix64)."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prints_of(shingles: np.ndarray, spread: np.ndarray, width: int) -> list[int]:
    """`width` fingerprints of a set of shingles, each of other hashes."""
    out = []
    for i in range(width):
        shingles = mixed(shingles) if i else shingles
        out.append(fingerprint(shingles, spread))
    return out


class Bands:
    """What candidate search takes for n sets of shingles: all of it follows from n and the least similarity.

    Of two sets of equal size with similarity s, a share of arccos(2s / (1 + s)) / pi of their fingerprints' bits differ. `width` fingerprints
    (two up to 1e8 sets, one more for each factor of 1e4) keep unrelated pairs under `total`, the mean plus three deviations. Tries are rooted at
    `bits` bits so that a root holds about per_root unrelated sets, and in as many `tables`, of random bits each, as a pair at s needs to
    share a root with a probability of 1 - miss.
    """

    def __init__(self, n: int, least: float, miss: float = 0.03, per_root: int = 32, seed: int = 5):
        differ = math.acos(2 * least / (1 + least)) / math.pi
        self.width = 2 + max(0, math.ceil(math.log(max(1, n) / 1e8, 1e4)))
        within = lambda m: int(m * differ + 3 * math.sqrt(m * differ * (1 - differ)))
        self.total, self.each = within(64 * self.width), within(64) + 3
        self.bits = min(48, max(6, math.ceil(math.log2(max(1, n) / per_root))))
        self.tables = math.ceil(math.log(1 / miss) / (1 - differ) ** self.bits)
        rng = np.random.default_rng([seed, self.bits])
        #: For each table its fingerprint's number and that fingerprint's bits in the table's order; 0 is the highest.
        self.orders = [(t % self.width, rng.permutation(64).tolist()) for t in range(self.tables)]

    def turned(self, turn: int, prints: np.ndarray) -> np.ndarray:
        which, order = self.orders[turn]
        return turned(prints[:, which], [(b, b + 1) for b in order])


def signatures(docs: DataFrame, shingle: int, seed: int, width: int) -> DataFrame:
    """(doc_id, node, n, p0, p1, ...): the number and size of each text's set of shingles, and the set's fingerprints."""
    prepare(docs.sparkSession)
    names = [f"p{i}" for i in range(width)]

    def make(batches):
        fresh_worker()
        spread = _spread()
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, shingle, seed)) for t in batch.column(1).to_pylist()]
            prints = np.array([prints_of(x, spread, width) for x in sets], np.uint64).reshape(-1, width).view(np.int64)
            nodes = np.array([set_number(x) for x in sets], np.uint64).view(np.int64)
            columns = [batch.column(0), pa.array(nodes), pa.array([len(x) for x in sets], pa.int64()), *[pa.array(prints[:, i].copy()) for i in range(width)]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "n", *names])

    return doc_columns(docs).mapInArrow(make, "doc_id long, node long, n long" + "".join(f", {x} long" for x in names))


def candidates(classes: DataFrame, bands: Bands, most: int = 20_000) -> DataFrame:
    """Edges (a, b) between nodes that span the pairs that share a root of some table and differ in at most bands.total bits, from (node, p0, p1, ...)."""
    names = [f"p{i}" for i in range(bands.width)]

    def root(batches):
        high = 1 << np.arange(bands.bits - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            prints = np.stack([batch[x].to_numpy() for x in names], axis=1)
            bits = np.unpackbits(prints.astype(">i8").view(np.uint8).reshape(batch.num_rows, -1), axis=1)
            roots = [bits[:, [64 * which + b for b in order[: bands.bits]]].astype(np.int64) @ high for which, order in bands.orders]
            again = pa.array(np.tile(np.arange(batch.num_rows), bands.tables))
            turns = np.repeat(np.arange(bands.tables, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(turns), pa.array(np.concatenate(roots)), *[batch[x].take(again) for x in ("node", *names)]], ["turn", "root", "node", *names])

    def spanning(turn: int, table: pa.Table):
        prints, node = np.stack([table[x].to_numpy() for x in names], axis=1).view(np.uint64), table["node"].to_numpy()
        values = bands.turned(turn, prints)
        order = np.argsort(values, kind="stable")
        others = np.delete(prints, bands.orders[turn][0], axis=1)[order]
        labels = trie_links(values[order], bands.bits, bands.each, 1 << 12, 1 << 10, others, bands.total)
        found = np.flatnonzero(labels != np.arange(len(labels)))
        return node[order[found]], node[order[labels[found]]]

    rooted = classes.select("node", *names).mapInArrow(root, "turn int, root long, node long" + "".join(f", {x} long" for x in names))
    return _joined(dealt(rooted, "node", most), spanning)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sets of shingles, as sorted distinct hashes; not both empty."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def similar_pairs(sets: list[np.ndarray], side: np.ndarray, least: float, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the pairs of sets with a Jaccard similarity of `least`; of sets on two sides, those between the sides. Sets that are known are connected already.

    A pair whose ends are connected already is passed over; others are compared exactly, in order of how far their fingerprints are apart.
    """
    spread = _spread()
    prints = np.array([prints_of(x, spread, 1) for x in sets], np.uint64).reshape(-1)
    sizes = np.array([len(x) for x in sets])
    labels, a, b, two = np.arange(len(sets)), [], [], len(np.unique(side)) > 1
    if known is not None and known.any():
        labels[known] = np.flatnonzero(known)[0]
    for i in range(1, len(sets)):
        near = np.minimum(sizes[:i], sizes[i]) >= least * np.maximum(sizes[:i], sizes[i]) - 1e-9
        if two:
            near &= side[:i] != side[i]
        near &= labels[:i] != labels[i]
        at = np.flatnonzero(near)
        for j in at[np.argsort(np.bitwise_count(prints[at] ^ prints[i]), kind="stable")]:
            if labels[i] == labels[j]:
                continue
            if similarity(sets[i], sets[j]) >= least - 1e-12:
                a.append(j)
                b.append(i)
                labels[labels == labels[i]] = labels[j]
    return np.array(a, np.int64), np.array(b, np.int64)


def verified(groups: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int, seed: int, least: float, most: int) -> DataFrame:
    """Edges (a, b) that span the similar pairs within each group of candidates (node, root), by the shingles themselves.

    Each node is compared with its group's root first, which is all that most groups of copies need. Nodes that aren't similar to it are
    then compared with each other and with the rest of the group: both are cut in parts of `most` nodes, and a task has two parts. What
    is sent grows with the group's size times the number of parts of such nodes.
    """
    spark = docs.sparkSession
    wanted, _ = materialize(groups.join(classes.select("node", "least"), "node").select("node", "root", "least"), "wanted")
    ids = wanted.select(F.col("least").alias("_id")).distinct()

    def number(batches):
        fresh_worker()
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, shingle, seed)) for t in batch.column(0).to_pylist()]
            nodes = np.array([set_number(x) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "shingles"])

    sets = doc_columns(docs).join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text").mapInArrow(number, "node long, shingles binary")
    sets = sets.join(wanted.select("node"), "node", "left_semi")
    sets, sets_path = materialize(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "shingles")
    members = wanted.where("node <> root").select("node", "root").join(sets, "node")
    pivots = wanted.where("node = root").select("node").join(sets, "node").select(F.col("node").alias("root"), F.col("shingles").alias("others"))

    def star(batches):
        for batch in batches:
            like = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least - 1e-12 for x, y in zip(batch["shingles"].to_pylist(), batch["others"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["node"], batch["root"], pa.array(like, pa.bool_())], ["node", "root", "like"])

    seen, seen_path = materialize(members.join(pivots, "root").select("node", "root", "shingles", "others").mapInArrow(star, "node long, root long, like boolean"), "star")
    rows = seen.unionByName(wanted.where("node = root").select("node", "root", F.lit(True).alias("like")))
    open_, _ = materialize(seen.groupBy("root").agg(F.count_if(~F.col("like")).alias("apart"), (F.count_if("like") + 1).alias("alike")).where("apart > 0"), "open-groups")
    open_ = open_.select("root", F.ceil(F.col("apart") / most).alias("r"), F.ceil(F.col("alike") / most).alias("v"))
    # Parts of nodes apart from the root come first; every pair of parts has one of these.
    part = F.when(F.col("like"), F.col("r") + F.pmod(F.xxhash64("node"), F.col("v"))).otherwise(F.pmod(F.xxhash64("node"), F.col("r")))
    placed = rows.join(open_, "root").withColumn("part", part)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.when(F.col("like"), F.col("r") - 1).otherwise(F.col("r") + F.col("v") - 1)), lambda j: F.struct(F.least(j, F.col("part")).alias("p"), F.greatest(j, F.col("part")).alias("q")))
    placed = placed.select(F.lit(0).alias("turn"), "root", "node", "like", "part", F.explode(pairs).alias("x")).select("turn", "root", "x.p", "x.q", "node", "like", "part").join(sets, "node")

    def spanning(turn: int, table: pa.Table):
        nodes, roots, part, like = (np.asarray(table[x].to_numpy()) for x in ("node", "root", "part", "like"))
        found = [[], []]
        for r in np.unique(roots):
            at = np.flatnonzero(roots == r)
            a, b = similar_pairs([np.frombuffer(table["shingles"][int(i)].as_py(), np.uint64) for i in at], part[at], least, like[at].astype(bool))
            found[0].append(nodes[at[a]])
            found[1].append(nodes[at[b]])
        return [np.concatenate([np.empty(0, np.int64), *x]) for x in found]

    keys = ("turn", "root", "p", "q")
    met = placed.repartition(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    edges, _ = materialize(_joined(met, spanning, held_rows=2 * most).unionByName(seen.where("like").select(F.col("node").alias("a"), F.col("root").alias("b"))), "similar")
    remove(spark, sets_path)
    remove(spark, seen_path)
    return edges


def similar_groups(docs: DataFrame, shingle: int = 5, seed: int = 42, least: float = 0.8, most: int = 512) -> DataFrame:
    """One row per document row: doc_id, fp (the number of its set of shingles), component_id (the least doc_id that links reach), root.

    A link joins two texts whose sets of shingles have a Jaccard similarity of `least`. Fingerprints only find candidates, as Bands
    says. Texts of equal sets are one node; one without words is alone with its like.
    """
    bands = Bands(docs.count(), least)
    made, _ = materialize(signatures(docs, shingle, seed, bands.width), "signatures")
    prints = [f"p{i}" for i in range(bands.width)]
    classes, _ = materialize(made.groupBy("node").agg(F.first("n").alias("n"), *[F.first(p).alias(p) for p in prints], F.min("doc_id").alias("least")), "shingle-sets")
    found, found_path = materialize(candidates(classes.where("n > 0"), bands).distinct(), "candidates")
    groups, _ = materialize(components(found, "a", "b"), "candidate-groups")
    remove(docs.sparkSession, found_path)
    release_shuffles(docs.sparkSession)
    edges = verified(groups, docs, classes, shingle, seed, least, most)
    release_shuffles(docs.sparkSession)
    names, _ = materialize(named(classes.select("node", "least"), edges, "node").select("node", "component_id", "root"), "similar-names")
    return made.select("doc_id", "node").join(names, "node").select("doc_id", F.col("node").alias("fp"), "component_id", "root")

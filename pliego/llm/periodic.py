"""Periodic runs of words, by a suffix automaton whose end-position sets are merged small to large.

A run is a stretch of consecutive words with smallest period q, as long as `least` words and `exponent` periods, that no neighbouring word extends.
Its words from the second period on have all come at most q words before, so a text is first cut where a word hasn't come lately enough for any run
to go on (`stretches`, exact); most prose ends there. Each stretch left becomes a suffix automaton. Its states' sets of end positions are merged up the
links, the smaller into the larger; positions i < j that become neighbours in a state as long as their distance seed a square of period j - i, which the
state's length extends to the left as far as it goes, and of the seeds of one run that one is kept which no word extends to the right. A pair meets
first in the state of its longest common suffix, so every run has exactly one such seed; neighbours only, so its period is the smallest. States too
short for any run are not merged.

A document is one task's work, in arrays of 16 bytes a state; nothing is shuffled.

Defined results: a null or empty text, or one of white space, has no words and no runs, and collapses to the empty text; a null id is an id like others; repeated rows are each
answered; ties of length go to the smallest start, then period; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import prepare

RUNS = "array<struct<start:long,length:long,period:long>>"


class Ends:
    """An ordered set of positions, in blocks, so that neither the first nor the last of many is dear to add."""

    SHIFT = 9

    def __init__(self, first: int):
        self.blocks, self.order, self.size = {first >> self.SHIFT: [first]}, [first >> self.SHIFT], 1

    def __iter__(self):
        for b in self.order:
            yield from self.blocks[b]

    def add(self, x: int) -> None:
        b = x >> self.SHIFT
        block = self.blocks.get(b)
        if block is None:
            self.blocks[b] = [x]
            insort(self.order, b)
        else:
            insort(block, x)
        self.size += 1

    def before(self, x: int) -> int:
        """The next smaller position; -1 if there is none."""
        b = x >> self.SHIFT
        block = self.blocks[b]
        k = bisect_left(block, x)
        if k:
            return block[k - 1]
        k = bisect_left(self.order, b)
        return self.blocks[self.order[k - 1]][-1] if k else -1

    def after(self, x: int) -> int:
        b = x >> self.SHIFT
        block = self.blocks[b]
        k = bisect_left(block, x) + 1
        if k < len(block):
            return block[k]
        k = bisect_left(self.order, b) + 1
        return self.blocks[self.order[k]][0] if k < len(self.order) else -1


class SuffixAutomaton:
    """States in flat arrays: a state's first transition stands in `symbol` and `target`, further ones in `more`, as few states have any."""

    def __init__(self, word_ids: list[int]):
        self.length, self.link, self.symbol, self.target = array("i", [0]), array("i", [-1]), array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.end: array = array("i", [-1])  # of states that stand for a prefix, its last position; -1 for copies
        last = 0
        for at, c in enumerate(word_ids):
            last = self._extend(last, c, at)

    def step(self, state: int, c: int) -> int:
        if self.symbol[state] == c:
            return self.target[state]
        rest = self.more.get(state)
        return rest.get(c, -1) if rest else -1

    def _set(self, state: int, c: int, to: int) -> None:
        if self.symbol[state] in (-1, c):
            self.symbol[state], self.target[state] = c, to
        else:
            self.more.setdefault(state, {})[c] = to

    def _state(self, length: int, link: int, end: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.symbol.append(-1)
        self.target.append(-1)
        self.end.append(end)
        return len(self.length) - 1

    def _extend(self, last: int, c: int, at: int) -> int:
        new, p = self._state(self.length[last] + 1, 0, at), last
        while p >= 0 and (q := self.step(p, c)) < 0:
            self._set(p, c, new)
            p = self.link[p]
        if p >= 0:
            if self.length[q] == self.length[p] + 1:
                self.link[new] = q
            else:
                copy = self._state(self.length[p] + 1, self.link[q], -1)
                self.symbol[copy], self.target[copy] = self.symbol[q], self.target[q]
                if q in self.more:
                    self.more[copy] = dict(self.more[q])
                while p >= 0 and self.step(p, c) == q:
                    self._set(p, c, copy)
                    p = self.link[p]
                self.link[q] = self.link[new] = copy
        return new


def shortest_state(least: int, exponent: int) -> int:
    """The length below which a state holds no seed of a run: a run of period d has a seed of its length less d."""
    d, best = 1, least + exponent
    while d * (exponent - 1) < best:
        best = min(best, max(least - d, (exponent - 1) * d))
        d += 1
    return best


def squares(word_ids: list[int], least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence."""
    s, n = word_ids, len(word_ids)
    a = SuffixAutomaton(s)
    a.more.clear()  # what follows needs links alone
    length, link, shortest = a.length, a.link, shortest_state(least, exponent)
    lengths = np.frombuffer(length, np.int32)
    order = np.flatnonzero(lengths >= shortest)
    order = order[np.argsort(-lengths[order], kind="stable")].tolist()
    sets: dict[int, Ends] = {}
    fresh: dict[int, list[int]] = {}  # positions that came to a state from its smaller parts
    found = []
    for v in order:
        own = sets.pop(v, None)
        if a.end[v] >= 0:
            if own is None:
                own = Ends(a.end[v])
            else:
                own.add(a.end[v])
                fresh.setdefault(v, []).append(a.end[v])
        m = length[v]
        for x in fresh.pop(v, ()):
            for i, j in ((own.before(x), x), (x, own.after(x))):
                d = j - i
                if i < 0 or j < 0 or d > m or m + d < max(least, exponent * d):
                    continue
                if (i < m or s[i - m] != s[j - m]) and (j + 1 == n or s[i + 1] != s[j + 1]):
                    found.append((i - m + 1, m + d, d))
        up = link[v]
        if length[up] < shortest:
            continue
        there = sets.get(up)
        if there is None:
            sets[up] = own
            continue
        if there.size > own.size:
            small, large = own, there
        else:  # what came before is in the smaller part now
            small, large = there, own
            fresh[up] = []
        moved = list(small)
        for x in moved:
            large.add(x)
        sets[up] = large
        fresh.setdefault(up, []).extend(moved)
    return sorted(set(found))


def stretches(ids: np.ndarray, least: int, exponent: int) -> list[tuple[int, int]]:
    """Parts [a, b) of a sequence that hold all its runs, each run whole in one part.

    A run's words after its first period all came at most that period before, and the run is `exponent` periods long. So such words lie between
    two places whose last occurrence is farther back than the part between them allows; parts are cut at these again until none is left, or until so little
    goes that cutting on could cost the square of the length. What is cut too seldom is longer than need be, no more.
    """
    n = len(ids)
    if n < least:
        return []
    order = np.argsort(ids, kind="stable")
    back = np.full(n, np.iinfo(np.int64).max)
    same = ids[order[1:]] == ids[order[:-1]]
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    shortest, todo, parts = shortest_state(least, exponent), [(0, n)], []
    while todo:
        a, b = todo.pop()
        most = (b - a) // (exponent - 1)
        cuts = np.flatnonzero(back[a:b] > most) + a
        if not len(cuts):
            parts.append((max(0, a - most), b))
            continue
        starts, ends = np.concatenate([[a], cuts + 1]), np.concatenate([cuts, [b]])
        long = ends - starts >= shortest
        for x, y in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            if 10 * (y - x) > 9 * (b - a):
                parts.append((max(0, x - (y - x) // (exponent - 1)), y))
            else:
                todo.append((x, y))
    out: list[tuple[int, int]] = []
    for a, b in sorted(parts):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def runs_of(words: list, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    seen: dict = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    found = []
    for a, b in stretches(ids, least, exponent):
        found += [(a + start, size, q) for start, size, q in squares(ids[a:b].tolist(), least, exponent)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that stay when of each run only its first period does."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, size, q in runs:
        edge[start + q] += 1
        edge[start + size] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def repeat_tail(doc_id: int | None, words: list) -> list:
    """What op11's contract plants: the words of every tenth document, by its id's checksum, repeat with a period from some place on."""
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4, words_of: Callable[[int | None, list], list] | None = None) -> DataFrame:
    """One row per document: doc_id, runs (by start, then period) and collapsed, its words without what runs repeat, joined by a space.

    words_of: what to make of a document's words first.
    """
    prepare(docs.sparkSession)

    def work(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            runs, texts = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (t or "").encode("utf-8", "surrogatepass").split()  # of bytes: at ASCII white space
                if words_of:
                    words = words_of(i, words)
                found = runs_of(words, least, exponent)
                runs.append([{"start": a, "length": b, "period": c} for a, b, c in found])
                texts.append(b" ".join(collapsed(words, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    chosen = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return chosen.mapInArrow(work, f"doc_id long, runs {RUNS}, collapsed string")


def longest(runs: Column) -> Column:
    """The greatest run of an array: by length, then smallest start, then period."""
    return F.element_at(F.array_sort(F.transform(runs, lambda r: F.struct((-r["length"]).alias("short"), r["start"].alias("start"), r["period"].alias("period")))), 1)


def digests(found: DataFrame) -> DataFrame:
    """periodic_runs as figures: how many runs, the longest, and checksums of all runs and of the collapsed text."""
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    some = F.size("runs") > 0
    out = found.withColumn("_top", F.when(some, longest(F.col("runs"))))
    length, period = -F.col("_top.short"), F.col("_top.period")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_top.start").alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )

"""Toxicity by noisy-channel deobfuscation.

A character trigram model over a-z (accents folded) and a gap is counted over all documents. A token that may be disguised
(signs or digits among its letters or at their ends, a letter twice in a row, letters spaced out one by one) becomes a lattice:
a sign may be the letters that it looks like, or noise; letters of other alphabets and full-width forms are the Latin ones that they look like; a run may be one letter or two; between spaced letters a word may end. The Viterbi path under the
trigram model and the channel's costs is the restored token. A token that isn't disguised has one path, itself.

Then a logistic model scores the restored text by the words and word beginnings that it holds. It is fitted on at most
`rows` labelled rows of each class (the first in hash order of their ids) out of those with crc32(id) mod 5 <> 0; its
features are the `most_features` that differ most between the classes there. Neither labels nor lang, source or doc_id are
inputs of a score.

Defined results: a null or empty text gets the score of no features; rows without an id count as held out; rows that share an
id are each scored; labels that are null are not learned from; without rows of both classes every score is 0; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import doc_columns, fresh_worker, materialize, prepare, shuffle_partitions, unsigned_crc32

GAP = 26
#: What signs stand for, besides noise.
LOOKS = {"@": "a", "4": "a", "8": "b", "(": "c", "3": "e", "6": "g", "9": "g", "1": "il", "!": "il", "|": "il", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "2": "z", "*": "aeiou", "#": "aeiou"}
NOISE = set("*#.-_~'^`,:;=/\\!|+")
#: Letters of other alphabets, by the Latin letter that they look like.
ALIKE = {"a": "\u0430\u03b1", "b": "\u0432\u03b2", "c": "\u0441\u03f2", "d": "\u0501", "e": "\u0435\u03b5", "h": "\u043d\u04bb", "i": "\u0456\u03b9\u0131", "j": "\u0458", "k": "\u043a\u03ba", "m": "\u043c", "n": "\u03b7", "o": "\u043e\u03bf", "p": "\u0440\u03c1", "q": "\u051b", "s": "\u0455", "t": "\u0442\u03c4", "u": "\u03c5", "v": "\u03bd\u0475", "w": "\u051d\u03c9", "x": "\u0445\u03c7", "y": "\u0443\u03b3"}
_ALIKE = str.maketrans({x: latin for latin, others in ALIKE.items() for x in others})
CHANNEL = {"sign": 0.7, "noise": 0.9, "gap": 8.0, "double": 0.9, "word": 1.0}
FOLDS = 5


def _fold_table() -> bytes:
    """For each Latin-1 byte its letter's code, 0 to 25, or GAP."""
    out = bytearray([GAP]) * 256
    for b in range(256):
        c = unicodedata.normalize("NFD", chr(b).lower())[0]
        out[b] = ord(c) - 97 if "a" <= c <= "z" else GAP
    out[0xDF], out[0xE6], out[0xF8] = ord("s") - 97, ord("a") - 97, ord("o") - 97
    out[0xC6], out[0xD8] = out[0xE6], out[0xF8]
    return bytes(out)


_FOLD = _fold_table()


def latin(token: str) -> str:
    """A token in lower case; where it isn't Latin-1, without full-width forms and loose accents, and with look-alikes of other alphabets as Latin letters."""
    low = token.lower()
    try:
        low.encode("latin-1")
    except UnicodeEncodeError:
        low = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c)).translate(_ALIKE).lower()
    return low


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("latin-1", "replace").translate(_FOLD), np.uint8)


def character_model(docs: DataFrame) -> np.ndarray:
    """Costs (minus log probability) of a code after two, 27 x 27 x 27, from all documents' trigrams."""

    def count(batches):
        fresh_worker()
        total = np.zeros(27**3, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    c = np.concatenate([[GAP, GAP], codes(t), [GAP]]).astype(np.int32)
                    total += np.bincount((c[:-2] * 27 + c[1:-1]) * 27 + c[2:], minlength=27**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    rows = docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()  # 27^3 at most
    n = np.full(27**3, 0.2)
    for r in rows:
        n[r.code] += r.n
    n = n.reshape(27, 27, 27)
    return -np.log(n / n.sum(axis=2, keepdims=True))


_RUN = re.compile(r"(.)\1*", re.S)
_SIGNS = re.escape("".join(x for x in LOOKS if not x.isalnum()))
_SUSPECT = re.compile(rf"([^\W\d_])\1|(\w)\2\2|\w[^\w\s]+\w|[^\W\d_]\d|\d[^\W\d_]|_|^[{_SIGNS}]|[{_SIGNS}]$", re.I)
_ENDS, _TWICE = re.compile(rf"^[{_SIGNS}]|[{_SIGNS}]$"), re.compile(r"(.)\1", re.I)
#: Words of one letter, which may stand beside a word spaced out.
_ONE = set("aeiouy")
#: Signs at the ends that stand for no letter; noise there has nothing to restore.
_TRIM = re.compile(rf"^[^\w{_SIGNS}]+|[^\w{_SIGNS}]+$")
_LETTER, _WORDS = re.compile(r"[^\W\d_]"), re.compile(r"[^\W\d_]+")


class Restorer:
    """Viterbi decoding of disguised tokens under a table of trigram costs."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()

    def options(self, sign: str, times: int, full: bool = False) -> list[tuple[tuple[int, ...], float]]:
        """The codes that a run of a sign may stand for, and their channel costs; where full, as many letters as signs, up to two."""
        code = int(codes(sign)[0]) if sign.isalpha() else GAP
        if code != GAP:
            if times == 1 or full:
                return [((code,) * min(times, 2), 0.0)]
            return [((code,), CHANNEL["double"] if times == 2 else 0.0), ((code, code), 0.0 if times == 2 else CHANNEL["double"])]
        out = [((ord(c) - 97,) * n, CHANNEL["sign"] * n) for c in LOOKS.get(sign, "") for n in range(min(times, 2) if full else 1, min(times, 2) + 1)]
        if full and out:
            return out
        if sign in NOISE:
            out.append(((), CHANNEL["noise"]))
        return out + [((GAP,), CHANNEL["gap"])]

    def __call__(self, token: str, full: bool = False) -> str:
        return self.path(self.options(m[1], len(m[0]), full) for m in _RUN.finditer(token.lower()))

    def spaced(self, letters: str) -> str:
        """As of a token, for letters that stand one by one: a word may end before any of them, and an equal letter may be the same one again."""
        low, steps = letters.lower(), []
        for i, sign in enumerate(low):
            step = self.options(sign, 1)
            if i:
                step = step + [((GAP, *e), x + CHANNEL["word"]) for e, x in step if e and e != (GAP,)]
                if sign == low[i - 1]:
                    step.append(((), CHANNEL["double"]))
            steps.append(step)
        return self.path(steps)

    def path(self, steps) -> str:
        best = {(GAP, GAP): (0.0, "")}
        for options in steps:
            now: dict = {}
            for (p, q), (cost, path) in best.items():
                for emitted, extra in options:
                    a, b, c, s = p, q, cost + extra, path
                    for x in emitted:
                        c += self.costs[a][b][x]
                        s += chr(97 + x) if x != GAP else " "
                        a, b = b, x
                    if (a, b) not in now or c < now[a, b][0]:
                        now[a, b] = (c, s)
            best = now
        return min((c + self.costs[p][q][GAP], s) for (p, q), (c, s) in best.items())[1]


class Reach:
    """Whether some path of a lattice may give a feature: a walk over the beginnings of features, where equal neighbours are one letter.

    It only spares decoding; what it lets through is decoded as any other token.
    """

    def __init__(self, names):
        words = {_RUN.sub(r"\1", f[1:]) for f in names if f[1:].isascii() and f[1:].isalpha()}
        self.ends, self.ways = words, {w[:k] for w in words for k in range(1, len(w) + 1)}
        self.kinds: dict[str, tuple[str, bool, bool]] = {}

    def _kind(self, sign: str) -> tuple[str, bool, bool]:
        """The letters that a sign may be, whether it may be noise, and whether a word may end at it."""
        code = int(codes(sign)[0]) if sign.isalpha() else GAP
        kind = (chr(97 + code), False, False) if code != GAP else (LOOKS.get(sign, ""), sign in NOISE, True)
        if len(self.kinds) < 10_000:
            self.kinds[sign] = kind
        return kind

    def __call__(self, token: str, anywhere: bool = False) -> bool:
        """anywhere: a word may begin at every sign."""
        states, last, solid, ways = {""}, "", token.isalpha() and token.isascii() and not anywhere, self.ways
        for sign in token:
            if sign == last:
                continue
            last = sign
            letters, noise, gap = self.kinds.get(sign) or self._kind(sign)
            now = set(states) if noise else set()
            if gap or anywhere:
                now.add("")
            for x in letters:
                for s in states:
                    if s[-1:] == x:
                        now.add(s)
                    elif (t := s + x) in ways:
                        if t in self.ends:
                            return True
                        now.add(t)
            if solid and not now:
                return False
            states = now
        return False


class Features:
    """The features of a text: words of its tokens as written and as restored, and beginnings of words. With keep, the numbers of those in it."""

    def __init__(self, costs: np.ndarray, keep=None, max_entries: int = 300_000):
        self.restore, self.keep, self.max_entries = Restorer(costs), keep, max_entries
        self.reach = Reach(keep) if keep is not None else None
        self.heads = {f[1:4] for f in keep} if keep is not None else None
        self.cache: dict[str, tuple] = {}

    def _of_word(self, word: str) -> list[str]:
        if len(word) < 3 or self.heads is not None and word[:3] not in self.heads:
            return []
        return [f"={word}", *(f"^{word[:k]}" for k in (4, 5, 6) if len(word) >= k)]

    def _found(self, words) -> tuple:
        found = {f for w in words for f in self._of_word(w)}
        return tuple(found if self.keep is None else (self.keep[f] for f in found if f in self.keep))

    def _of_token(self, token: str) -> tuple:
        bare = latin(token)
        if not bare.isalpha():
            bare = _TRIM.sub("", bare)
            letters = len(_LETTER.findall(bare))
            words = set(_WORDS.findall(bare))
        else:
            letters, words = len(bare), {bare}
        if letters and (letters > 1 or 1 + sum(map(LOOKS.__contains__, bare)) > 2) and _SUSPECT.search(bare) and (self.reach is None or self.reach(bare)):
            words.update(self.restore(bare).split())
            # A sign at an end may be punctuation or a letter, a doubled one a letter or two: both readings count.
            if _ENDS.search(bare) or _TWICE.search(bare) and not bare.isalpha():
                words.update(self.restore(bare, full=True).split())
        return self._found(words)

    def __call__(self, text: str | None) -> set:
        if len(self.cache) > self.max_entries:
            self.cache = {}
        tokens, out, cache = (text or "").split(), set(), self.cache
        for t in set(tokens):
            if (f := cache.get(t)) is None:
                f = cache[t] = self._of_token(t)
            if f:
                out.update(f)
        # Letters spaced out one by one make a token of their own.
        ones = [i for i, t in enumerate(tokens) if len(t) == 1 and (t.isalpha() or t in LOOKS)]
        for a, b in _runs(ones):
            if b - a >= 2:
                joined = latin("".join(tokens[a : b + 1]))
                first, last = joined[0] in _ONE, joined[-1] in _ONE
                readings = {joined, *([joined[1:]] if first else []), *([joined[:-1]] if last else []), *([joined[1:-1]] if first and last else [])}
                if self.reach is None or self.reach(joined, anywhere=True):
                    out.update(self._found({w for x in readings for w in (x, *self.restore(x).split(), *self.restore(x, full=True).split(), *self.restore.spaced(x).split())}))
                else:
                    out.update(self._found(readings))
        return out


def _runs(places: list[int]):
    """First and last of each run of neighbouring numbers."""
    start = None
    for i, at in enumerate(places):
        start = at if start is None else start
        if i + 1 == len(places) or places[i + 1] != at + 1:
            yield start, at
            start = None


def fit_logistic(rows: list[list[int]], y: np.ndarray, size: int, l2: float = 1e-3, steps: int = 400, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model over sets of features, by Adam on the class-balanced loss."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    what = np.array([f for r in rows for f in r], np.int64)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        z = np.bincount(at, w[what], len(rows)) + w[size]
        d = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.append(np.bincount(what, d[at], size) + l2 * w[:size] / max(1, size), d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:size], float(w[size])


def select_features(chosen: DataFrame, costs: np.ndarray, most: int) -> list[str]:
    """The features of the largest likelihood-ratio statistic for class 1, of those that three of its rows hold at least. Counted in parallel."""

    def tally(batches):
        f, n = Features(costs), (Counter(), Counter())
        for batch in batches:
            for text, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                n[c].update(f(text))
                n[c][""] += 1  # the rows themselves
        names = list(n[0].keys() | n[1].keys())
        for a in range(0, len(names), 10_000):
            part = names[a : a + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([n[1][x] for x in part]), pa.array([n[0][x] for x in part])], ["feature", "n1", "n0"])

    counts = chosen.mapInArrow(tally, "feature string, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where("n1 >= 3").persist()
    rows = counts.where("feature = ''").first()
    if rows is None or not rows.n0:
        return []
    in1, in0, all1, all0 = F.col("n1").cast("double"), F.col("n0").cast("double"), float(rows.n1), float(rows.n0)
    g = F.lit(0.0)
    for k1, k0 in ((in1, in0), (all1 - in1, all0 - in0)):
        share = (k1 + k0) / (all1 + all0)
        for seen, total in ((k1, all1), (k0, all0)):
            g = g + F.when(seen > 0, seen * F.log(seen / (share * total))).otherwise(0.0)
    best = counts.where("feature <> ''").where(in1 / all1 > in0 / all0).withColumn("g", g).where("g > 4").orderBy(F.desc("g"), "feature").limit(most)
    out = [r.feature for r in best.select("feature").collect()]
    counts.unpersist()
    return out


def held_out(doc_id) -> "F.Column":
    return F.coalesce(unsigned_crc32(doc_id) % FOLDS == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic) of at most `rows` ids of either label that aren't held out. Of rows that share an id, however many, one stands for it: that of the least hash."""
    y = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where("toxic IN (0, 1) AND doc_id IS NOT NULL")
    y = y.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = F.xxhash64(F.lit("sample"), "doc_id")
    sample = y.where("toxic = 1").orderBy(first).limit(rows).unionByName(y.where("toxic = 0").orderBy(first).limit(rows))
    # 2 * rows rows of two numbers at most: the documented bound of the sample.
    one = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "toxic")).alias("r"))
    return one.select("r.text", "r.toxic")


def fit(docs: DataFrame, labels: DataFrame, costs: np.ndarray, rows: int, most_features: int) -> tuple[dict[str, int], np.ndarray, float]:
    # Written, as it is read three times, and dealt evenly, as its few rows are dear.
    chosen, _ = materialize(labelled_sample(docs, labels, rows).repartition(shuffle_partitions(docs.sparkSession)), "labelled")
    names = {f: i for i, f in enumerate(select_features(chosen, costs, most_features))}
    if not names:
        return {}, np.empty(0), -np.inf

    def describe(batches):
        f = Features(costs, names)
        for batch in batches:
            sets = [sorted(f(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.int32())), batch.column(1)], ["features", "toxic"])

    got = chosen.mapInArrow(describe, "features array<int>, toxic int").toArrow().to_pylist()
    rows_ = sorted((r["features"], r["toxic"]) for r in got)  # in one order, whichever way they came
    return names, *fit_logistic([f for f, _ in rows_], np.array([y for _, y in rows_], np.int64), len(names))


def scorer(docs: DataFrame, labels: DataFrame, rows: int = 4000, most_features: int = 2000):
    """A function of a list of texts to their scores, fitted on docs and labels; the model travels as a broadcast."""
    spark = docs.sparkSession
    prepare(spark)
    docs = doc_columns(docs)
    costs = character_model(docs)
    names, weights, bias = fit(docs, labels, costs, rows, most_features)
    model = spark.sparkContext.broadcast((names, weights, bias, costs))  # most_features entries at most
    held: list[Features] = []

    def rate(texts: list[str | None]) -> np.ndarray:
        names, weights, bias, costs = model.value
        if not held:
            fresh_worker()
            held.append(Features(costs, names))
        z = np.array([bias + weights[list(held[0](t))].sum() for t in texts], np.float64)
        return np.where(np.isneginf(z), 0.0, 1 / (1 + np.exp(-np.clip(z, -700, 700))))

    return rate


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted."""
    rate = scorer(docs, labels, **options)

    def add(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rate(batch.column(1).to_pylist()))], ["doc_id", "score"])

    out = doc_columns(docs).mapInArrow(add, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without the rows predicted toxic; all columns stay."""
    rate = scorer(docs, labels, **options)
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(rate(batch.column(at).to_pylist()) < 0.5))

    return docs.mapInArrow(keep, docs.schema)

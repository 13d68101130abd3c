"""Rules by key on streams whose rows come in any order within a delay, with timers that act when no further row comes.

A row waits in the state until the watermark has passed it; then a key's rows are stepped through in order of time, whatever batches they came in, so a stream gives what the
finished table would. A rule may set one due time; it is told when that has come, before any row of that time or later, and also where no row follows. A
rule without state and a key without waiting rows leave nothing in the store. Rows that come later than the delay are dropped by Spark, which counts them (`late_rows`).
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# A processor is also made in a worker on the driver, which has no files that a session ships: so this module travels with it, not by name.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: State with timers needs this store; a session has it as spark.sql.streaming.stateStore.providerClass.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Codes:
    """Tells a code unless it is the one told last, less than `quiet` milliseconds ago. What was told is forgotten after that time."""

    schema, fields = "key string, at long, code string", ("code",)

    def __init__(self, quiet: int = 3000):
        self.quiet = quiet

    def row(self, state, at: int, row: tuple):
        code = row[0]
        if state is not None and state[0] == code:
            return state, state[1] + self.quiet, []
        return (code, at), at + self.quiet, [(at, code)]

    def due(self, state, at: int):
        return None, None, []


class Lock:
    """Locks `wait` milliseconds after the library was hidden, unless it is shown before."""

    schema, fields = "key string, at long, locked boolean", ("hidden",)

    def __init__(self, wait: int = 60_000):
        self.wait = wait

    def row(self, state, at: int, row: tuple):
        if not row[0]:
            return None, None, []
        since = at if state is None else state
        return since, (since + self.wait if since >= 0 else None), []

    def due(self, state, at: int):
        return -1, None, [(at, True)]  # locked until it is shown


class Backoff:
    """Failed attempts: each tells how many there were and when the next is allowed; that time is told as well if nothing was tried before. A success starts anew."""

    schema, fields = "key string, at long, failures int, until long", ("ok",)

    def __init__(self, free: int = 5, first: int = 30_000, most: int = 900_000):
        self.free, self.first, self.most = free, first, most

    def row(self, state, at: int, row: tuple):
        if row[0]:
            return None, None, []
        n = (state or 0) + 1
        wait = 0 if n < self.free else min(self.first * 2 ** min(n - self.free, 40), self.most)
        return n, at + wait if wait else None, [(at, n, at + wait)]

    def due(self, state, at: int):
        return state, None, [(at, state, None)]


class Ordered(StatefulProcessor):
    """A rule over rows (key, at, tie, fields…) in order of (at, tie)."""

    def __init__(self, rule):
        self.rule = rule

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows string")  # a batch's rows are one entry
        self.state = handle.getValueState("state", "state string, due long")

    def _now(self) -> tuple:
        got = self.state.get() if self.state.exists() else None
        return (None, None) if got is None else (None if got[0] is None else json.loads(got[0]), got[1])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        plain = lambda x: x.item() if hasattr(x, "item") else x
        for pdf in rows:
            new = [[int(at), int(tie), *map(plain, row)] for at, tie, *row in zip(pdf["at"], pdf["tie"], *[pdf[c] for c in self.rule.fields], strict=True)]
            if not new:
                continue
            self.waiting.appendValue((json.dumps(new),))
            first, timers = min(r[0] for r in new), list(self.handle.listTimers())
            if not timers or first < min(timers):  # the one there is, is that of all before
                for t in timers:
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(first)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = timerValues.getCurrentWatermarkInMs() - 1  # no row of that time or before is still to come
        state, due = self._now()
        rows = {(at, tie): row for (entry,) in self.waiting.get() for at, tie, *row in json.loads(entry)} if self.waiting.exists() else {}
        out, rest = [], [[*k, *row] for k, row in rows.items() if k[0] > end]
        for at, tie in sorted(k for k in rows if k[0] <= end):
            while due is not None and due <= at:
                state, due, told = self.rule.due(state, due)
                out += told
            state, due, told = self.rule.row(tuple(state) if isinstance(state, list) else state, at, tuple(rows[at, tie]))
            out += told
        if not rest:
            self.waiting.clear()
        elif len(rest) < len(rows):
            self.waiting.put([(json.dumps(rest),)])
        while due is not None and due <= end:
            state, due, told = self.rule.due(state, due)
            out += told
        if state is None and due is None:
            self.state.clear()
        else:
            self.state.update((None if state is None else json.dumps(state), due))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if times := [*(r[0] for r in rest), *([due] if due is not None else [])]:
            self.handle.registerTimer(min(times))
        names = [c.split()[0] for c in self.rule.schema.split(", ")]
        yield pd.DataFrame([(key[0], *x) for x in out], columns=names)

    def close(self) -> None:
        pass


def over_stream(rows: DataFrame, rule, delay: str) -> DataFrame:
    """rows (key string, time timestamp, tie long, and the rule's fields): what the rule tells, each row once its time has passed. tie orders rows of one millisecond and tells them apart."""
    rows = rows.select("key", "time", F.unix_millis("time").alias("at"), "tie", *rule.fields).withWatermark("time", delay)
    return rows.groupBy("key").transformWithStateInPandas(Ordered(rule), rule.schema, "append", "EventTime")


def sessions(rows: DataFrame, gap: str, delay: str) -> DataFrame:
    """rows (key, time): (key, first, last, n) of each stretch without a pause longer than gap, once no row can belong to it."""
    # A window ends before its gap is over; a microsecond more, and rows a whole gap apart are together.
    window = F.session_window("time", f"{gap} 1 microsecond")
    marked = rows.withWatermark("time", delay)
    return marked.groupBy("key", window).agg(F.min("time").alias("first"), F.max("time").alias("last"), F.count("*").alias("n")).select("key", "first", "last", "n")


def late_rows(query) -> int:
    """How many rows of a query came too late for its state."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def run(stream: DataFrame, out: str, checkpoint: str, mode: str = "append"):
    """Writes what a stream gives on what is there now, and ends."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q

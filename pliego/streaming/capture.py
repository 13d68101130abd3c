"""The code filter over finished rows, in sorted batches, and over streams in order; stillness as windows. Rules with timers and rows out of order: timers.py."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..operators import library
from ..sources.shared import ship


class CodeFilter:
    """A camera tells a code unless it is the one told last and was put away less than `quiet` ago; while one is shown, none is told.

    Only the last code counts: of A, B, A in a row all are told. Rows: camera, code, at, and shown (ms that the code was shown once told), 0 if absent.
    """

    schema = "camera string, code string, at long"

    def __init__(self, quiet_ms: int = 3000, state: dict | None = None):
        self.quiet, self.last, self.away = quiet_ms, *(state or {}).get("last", (None, None))

    def state(self) -> dict:
        return {"last": [self.last, self.away]}

    def step(self, row: dict) -> dict | None:
        if self.away is not None and (row["at"] < self.away or row["code"] == self.last and row["at"] - self.away < self.quiet):
            return None
        self.last, self.away = row["code"], row["at"] + int(row.get("shown") or 0)
        return {"camera": row.get("camera"), "code": row["code"], "at": row["at"]}


def stillness(frames: DataFrame, tolerance: float, still_ms: int = 200, most_ms: int = 1500) -> DataFrame:
    """frames (shot, pressed, at, motion): (shot, pressed, taken), when each photo may be taken.

    That is once the camera was still for still_ms, or after most_ms. What counts as still loosens evenly, to twice the tolerance at the end.
    """
    waited = F.col("at") - F.col("pressed")
    seen = frames.where((waited >= 0) & (waited < most_ms)).withColumn("_moves", (F.col("motion") > tolerance * (1 + waited / most_ms)).cast("int"))
    order = Window.partitionBy("shot").orderBy("at")
    run = Window.partitionBy("shot", "_run")
    seen = seen.withColumn("_run", F.sum("_moves").over(order)).withColumn("_since", F.min(F.when(F.col("_moves") == 0, F.col("at"))).over(run))
    done = F.min(F.when((F.col("_moves") == 0) & (F.col("at") - F.col("_since") >= still_ms), F.col("at")))
    pressed = frames.groupBy("shot").agg(F.min("pressed").alias("pressed"))
    found = seen.groupBy("shot").agg(done.alias("_done"))
    return pressed.join(found, "shot", "left").select("shot", "pressed", F.coalesce("_done", F.col("pressed") + most_ms).alias("taken"))


def over_batch(rows: DataFrame, key: str, machine: Callable[..., object], order: str | tuple[str, ...] = "at", within: tuple[str, ...] = (), **options) -> DataFrame:
    """The machine's output over finished rows, each key's in order. Rows are sorted by Spark and pass in batches, so a key's history is never held whole.

    within: columns that part a key into stretches between which the machine's state doesn't matter.
    """
    columns = [c.split()[0] for c in machine.schema.split(", ")]
    orders = (order,) if isinstance(order, str) else order
    parts = (key, *within)
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, now = None, None
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                k = tuple(None if r[c] is None or r[c] != r[c] else r[c] for c in parts)
                if m is None or k != now:
                    m, now = machine(**options), k
                if e := m.step(r):
                    out.append(e)
            yield pd.DataFrame(out, columns=columns)

    return rows.repartition(*parts).sortWithinPartitions(*parts, *orders).mapInPandas(run, machine.schema)


def over_stream(rows: DataFrame, key: str, machine: Callable[..., object], order: str = "at", **options) -> DataFrame:
    """The machine over a stream; its state lives in the query's state store."""
    columns = [c.split()[0] for c in machine.schema.split(", ")]
    ship(rows.sparkSession)

    def run(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = machine(**options, state=json.loads(state.get[0]) if state.exists else None)
        for pdf in batches:
            yield pd.DataFrame([e for r in pdf.sort_values(order, kind="stable").to_dict("records") if (e := m.step(r))], columns=columns)
        state.update((json.dumps(m.state(), default=float),))

    return rows.groupBy(key).applyInPandasWithState(run, machine.schema, "state string", "append", GroupStateTimeout.NoTimeout)


def quiet_stretches(scans: DataFrame, key: str, quiet_ms: int, name: str = "_stretch") -> DataFrame:
    """scans (key, at, and perhaps shown) with a number that changes only after a pause longer than quiet_ms.

    Time is cut into spans of that length; spans in use next to each other, up to one that isn't, are a stretch: a span's number less its place among those in use. Places come from
    counts of ranges, so a key with most of the rows is many tasks' work.
    """
    first = F.floor(F.col("at") / quiet_ms)
    shown = F.coalesce(F.col("shown"), F.lit(0)) if "shown" in scans.columns else F.lit(0)
    used = scans.select(F.col(key).alias("_k"), F.explode(F.sequence(first, F.floor((F.col("at") + shown) / quiet_ms))).alias("_b")).distinct()
    placed = library.numbered(used, "_k", "_b").select("_k", "_b", (F.col("_b") - F.col("n")).alias(name))
    out = scans.withColumn("_first", first).join(placed, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_first") == F.col("_b")))
    return out.select(*scans.columns, name)


def accepted_codes_batch(scans: DataFrame, quiet_ms: int = 3000, order: str | tuple[str, ...] = "at") -> DataFrame:
    """scans (camera, code, at): those that are told. A camera's stretches between pauses are told apart by themselves, as after a pause any code is told."""
    return over_batch(quiet_stretches(scans, "camera", quiet_ms), "camera", CodeFilter, order, within=("_stretch",), quiet_ms=quiet_ms)

"""Streams with timers and sessions, in several orders of batches, against plain loops over sorted rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pliego.streaming import capture, timers

SCHEMA = "key string, time timestamp, tie long, code string, hidden boolean, ok boolean"


def events():
    rng = random.Random(9)
    out, at = [], 1_700_000_000_000
    for tie in range(400):
        at += rng.choice([0, 400, 900, 2500, 4000, 40_000])
        out.append((rng.choice("ab") if tie < 300 else "a", at, tie, rng.choice("xy"), rng.random() < 0.6, rng.random() < 0.15))
    out.append(("c", at + 1, 400, "x", True, False))  # no row of its key follows
    return out


def streamed(spark, folder, batches, delay, make):
    """The result of a stream over batches, each a file, with a last row that moves the watermark past all."""
    top = max(r[1] for b in batches for r in b)
    for b in [*batches, [("end", top + 10**8, -1, "x", False, True)], [("end", top + 2 * 10**8, -2, "x", False, True)]]:
        rows = spark.createDataFrame(b, SCHEMA.replace("time timestamp", "time long")).withColumn("time", F.timestamp_millis("time"))
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.02)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timers.STORE)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        q = timers.run(make(stream, delay), f"{folder}/out", f"{folder}/state")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return sorted((tuple(r) for r in spark.read.parquet(f"{folder}/out").where("key <> 'end'").collect()), key=repr), q


def codes(rows, quiet=3000):
    out, last = [], {}
    for key, at, _, code, *_ in rows:
        if key in last and last[key][0] == code and at - last[key][1] < quiet:
            continue
        last[key] = (code, at)
        out.append((key, at, code))
    return out


def locks(rows, wait=30_000):
    out = []
    for key in {r[0] for r in rows}:
        since = None
        for _, at, _, _, hidden, _ in [*(r for r in rows if r[0] == key), (key, 10**15, 0, "", False, True)]:
            if since is not None and since != "locked" and at - since >= wait:
                out.append((key, since + wait, True))
                since = "locked"
            since = (at if since is None else since) if hidden else None
    return out


def failures(rows):
    out = []
    for key in {r[0] for r in rows}:
        n, until = 0, None
        for _, at, _, _, _, ok in [*(r for r in rows if r[0] == key), (key, 10**15, 0, "", False, True)]:
            if until is not None and until <= at:
                out.append((key, until, n, None))
            until = None
            if at == 10**15:
                break
            n = 0 if ok else n + 1
            if not ok:
                wait = 0 if n < 5 else min(30_000 * 2 ** (n - 5), 900_000)
                until = at + wait if wait else None
                out.append((key, at, n, at + wait))
    return out


def orders(rows):
    rng = random.Random(2)
    shuffled = rng.sample(rows, len(rows))
    return {"in order": ([rows[k : k + 120] for k in range(0, len(rows), 120)], "1 second"), "shuffled": ([shuffled[k : k + 150] for k in range(0, len(rows), 150)], "10 hours"), "neighbours swapped": ([rows[100:200], rows[:100], rows[300:], rows[200:300]], "2 hours")}


@pytest.mark.parametrize("order", ["in order", "shuffled", "neighbours swapped"])
@pytest.mark.parametrize(("rule", "brute"), [(timers.Codes(), codes), (timers.Lock(30_000), locks), (timers.Backoff(), failures)])
def test_rules_in_any_order_of_batches(spark, tmp_path, order, rule, brute):
    rows = events()
    batches, delay = orders(rows)[order]
    got, q = streamed(spark, str(tmp_path), batches, delay, lambda s, d: timers.over_stream(s, rule, d))
    want = sorted(brute(rows), key=repr)
    assert got == want and timers.late_rows(q) == 0
    if isinstance(rule, timers.Lock):
        assert ("c", rows[-1][1] + 30_000, True) in got  # by its timer alone


@pytest.mark.parametrize("order", ["in order", "shuffled"])
def test_sessions(spark, tmp_path, order):
    rows = events()
    batches, delay = orders(rows)[order]
    got, _ = streamed(spark, str(tmp_path), batches, delay, lambda s, d: timers.sessions(s, "4 seconds", d).withColumns({c: F.unix_millis(c) for c in ("first", "last")}))
    want = []
    for key in "abc":
        at = [r[1] for r in rows if r[0] == key]
        cut = [0, *(k for k in range(1, len(at)) if at[k] - at[k - 1] > 4000), len(at)]
        want += [(key, at[a], at[b - 1], b - a) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    assert got == sorted(want, key=repr)


def test_late_rows_are_counted(spark, tmp_path):
    rows = [r for r in events() if r[0] == "a"]
    late = [(*rows[0][:2], 10_000 + k, *rows[0][3:]) for k in range(3)]
    got, q = streamed(spark, str(tmp_path), [rows[:150], rows[150:], late], "1 second", lambda s, d: timers.over_stream(s, timers.Codes(), d))
    assert got == sorted(codes(rows), key=repr) and timers.late_rows(q) == 3


@pytest.mark.parametrize("shown", [0, 700])
def test_codes_over_finished_rows_in_stretches(spark, shown):
    rows = [(r[0] if r[0] != "c" else None, r[3], r[1], shown, r[2]) for r in events()]
    df = spark.createDataFrame(rows, "camera string, code string, at long, shown long, tie long").repartition(3)
    want = []
    for camera in ("a", "b", None):
        m = capture.CodeFilter(3000)
        want += [(camera, e["code"], e["at"]) for r in rows if r[0] == camera and (e := m.step({"camera": camera, "code": r[1], "at": r[2], "shown": r[3]}))]
    assert sorted(map(tuple, capture.accepted_codes_batch(df, order=("at", "tie")).collect()), key=repr) == sorted(want, key=repr)
    stretches = capture.quiet_stretches(df, "camera", 3000)
    assert stretches.select("camera", "_stretch").distinct().count() > 20 and stretches.count() == len(rows)


def test_waiting_rows_of_a_batch_are_one_entry():
    import pandas as pd

    class Handle:
        def __init__(self):
            self.entries, self.timers = [], []

        def getListState(self, *_):  # noqa: N802
            return self

        def getValueState(self, *_):  # noqa: N802
            return self

        def appendValue(self, value):  # noqa: N802
            self.entries.append(value)

        def listTimers(self):  # noqa: N802
            return iter(self.timers)

        def registerTimer(self, t):  # noqa: N802
            self.timers.append(t)

        def deleteTimer(self, t):  # noqa: N802
            self.timers.remove(t)

    handle, job = Handle(), timers.Ordered(timers.Codes(3000))
    job.init(handle)
    for first in (5000, 1000, 9000):
        batch = pd.DataFrame({"at": range(first, first + 500), "tie": range(500), "code": ["x"] * 500})
        list(job.handleInputRows(("k",), iter([batch]), None))
    assert len(handle.entries) == 3 and handle.timers == [1000]

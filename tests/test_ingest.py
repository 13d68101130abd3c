"""Ingest and purge as jobs that may run again; places and order statistics of groups of any size."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from pliego.functions import dates
from pliego.operators import library
from pliego.sources.keylog import KeyLog
from pliego.streaming import ingest

PAGES = "doc string, id string, item array<double>"


def alike(a, b):
    return F.abs(F.get(a, F.lit(0)) - F.get(b, F.lit(0))) < 0.5


def pages(n):
    rng = random.Random(4)
    return [(rng.choice(["d", "d", "e", None]), f"{k:04}", None if rng.random() < 0.1 else [float(rng.randrange(6))]) for k in range(n)]


def repeats(rows, most=3):
    out, before = {}, {}
    for doc, page, item in rows:
        near = before.setdefault(doc, [])
        out[page] = next((p for p, x in reversed(near[-most:]) if item and x and abs(x[0] - item[0]) < 0.5), None)
        near.append((page, item))
    return out


def test_repeats_by_batches_and_a_batch_again(spark, tmp_path, monkeypatch):
    rows, root = pages(90), f"file://{tmp_path}/log"
    cuts = [rows[:40], rows[40:41], rows[41:90]]
    job = ingest.Repeats(spark, root, alike)
    for number, part in enumerate(cuts):
        df = spark.createDataFrame(part, PAGES)
        if number == 1:  # ends after the pages' log has the batch, before the last pages' log has
            with monkeypatch.context() as m:
                m.setattr(job.tails, "write", lambda *a, **k: (_ for _ in ()).throw(OSError("executor lost")))
                with pytest.raises(OSError):
                    job.batch(df, number)
            job = ingest.Repeats(spark, root, alike)
        job.batch(df, number)
        job.batch(df, number)
    got = job.pages.scan().collect()
    assert {r.id: r.repeats for r in got} == repeats(rows)
    assert sorted((r.doc or "", r.place) for r in got) == sorted((d or "", k + 1) for d in {r[0] for r in rows} for k in range(sum(x[0] == d for x in rows)))
    assert job.pages.done("pages") == job.tails.done("pages") == 2


def test_repeats_from_a_stream(spark, tmp_path):
    rows = pages(30)
    for k in (0, 10, 20):
        spark.createDataFrame(rows[k : k + 10], PAGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.02)
    job = ingest.Repeats(spark, f"file://{tmp_path}/log", alike)
    for _ in range(2):  # the second time nothing is new
        stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        job.start(stream, f"{tmp_path}/state").awaitTermination()
    assert {r.id: r.repeats for r in job.pages.scan().collect()} == repeats(rows)


def test_purges_follow_a_clock(spark, tmp_path):
    day = dates.DAY
    log = KeyLog(spark, f"file://{tmp_path}/log", "id long, papelera long", buckets=2)
    log.write(spark.createDataFrame([(1, None), (2, 0), (3, 5 * day), (4, 40 * day)], "id long, papelera long"))
    left = []
    for now in (30 * day, 31 * day, 36 * day):
        spark.createDataFrame([(now,)], "now long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/clock")
        stream = spark.readStream.schema("now long").parquet(f"{tmp_path}/clock")
        ingest.start_purges(stream, log, f"{tmp_path}/state").awaitTermination()
        left.append(sorted(r.id for r in log.scan().collect()))
    assert left == [[1, 2, 3, 4], [1, 3, 4], [1, 4]] and log.done("purge") == 2
    version = log.version()
    assert ingest.purge(log, 99 * day, batch=("purge", 2)) == version  # that batch is in already


def test_places_in_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k) for k in range(300)]
    df = spark.createDataFrame(rng.sample(rows, 300), "g string, k long")
    want, seen = {}, {}
    for g, k in rows:
        seen[g] = seen.get(g, 0) + 1
        want[k] = seen[g]
    for stretches in (1, 7):
        assert {r.k: r.n for r in library.numbered(df, "g", "k", stretches=stretches).collect()} == want
    assert library.numbered(df.where("false"), "g", "k").count() == 0


def greater(x):
    return (1, 0.0) if math.isnan(x) else (0, x)


@pytest.mark.parametrize("kind", ["double", "long"])
def test_order_statistics(spark, kind):
    rng = random.Random(7)
    if kind == "double":
        odd = [0.0, -0.0, 5e-324, 1e-323, 1e308, -1e308, float("inf"), float("-inf"), float("nan"), 1.0, 1.0 + 2**-52]
        make = lambda: rng.choice(odd) if rng.random() < 0.3 else rng.uniform(-1, 1) * 10 ** rng.uniform(-300, 300)
    else:
        odd = [0, 2**63 - 1, -(2**63), 2**62, 2**62 + 1]
        make = lambda: rng.choice(odd) if rng.random() < 0.3 else rng.randrange(-50, 50)
    rows = [(g, make()) for g in ["a"] * 200 + ["b"] * 3 + [None] * 50] + [("c", odd[0])] + [("d", None)]
    wanted = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r[0]: r for r in library.value_percentiles(spark.createDataFrame(rows, f"k string, v {kind}"), "k", "v", wanted).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, r in got.items():
        s = sorted((v for k, v in rows if k == g), key=greater if kind == "double" else None)
        for name, p in wanted.items():
            want = s[min(math.floor(len(s) * p), len(s) - 1)]
            assert r[name] == want or math.isnan(want) and math.isnan(r[name]), (g, name)


def test_order_statistics_sort_nothing(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.rand(1) * 1e6).alias("v"))
    out = library.value_percentiles(df, "k", "v", {"p": 0.5})
    assert "Window" not in out._jdf.queryExecution().toString() and out.count() == 3

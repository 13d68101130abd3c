"""Queries that stream events from files, written in several orders of time, through rules with timers, sessions and jobs; their SQL is over the finished tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared
from ..streaming import ingest, timers
from .catalogue import _CODES_SQL, _NEAREST_SQL, query, table

#: Days of a file; as rows of a file come before those of the file in front of it, at most so much twice is what rows are late by.
DAYS, DELAY = 8, "17 days"
HOUR = 3_600_000


def _files(spark, d, *columns) -> tuple[str, str]:
    """Events as files that come in another order than that of time: of each two neighbours the later first. A last row lets all others' times pass. Returns folder and schema."""
    folder = shared.workdir(spark, "events")
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").alias("time"), F.col("event_id").alias("tie"), *columns)
    first = e.agg(F.min(F.to_date("time")).alias("d")).first().d
    part = F.floor(F.datediff(F.to_date("time"), F.lit(first)) / DAYS)
    top = e.agg(F.max(part)).first()[0]
    if top is None:
        e.write.parquet(folder)
        return folder, e.schema
    for k in sorted(range(top + 1), key=lambda k: k ^ 1):
        e.where(part == k).coalesce(1).write.mode("append").parquet(folder)
    for days in (400, 800):
        last = [F.lit("").alias("key"), (F.max("time") + F.expr(f"INTERVAL {days} DAYS")).cast(e.schema["time"].dataType).alias("time"), F.lit(-days).cast("long").alias("tie")]
        e.agg(*last, *[F.lit(None).cast(e.schema[c].dataType).alias(c) for c in e.columns[3:]]).coalesce(1).write.mode("append").parquet(folder)
    return folder, e.schema


def _streamed(spark, folder, schema, make) -> DataFrame:
    """What a stream over the files gives, run to their end. Its state is dealt to as many partitions as there are cores, at most: each is a store that every batch opens."""
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    own = {"spark.sql.streaming.stateStore.providerClass": timers.STORE, "spark.sql.shuffle.partitions": str(parts)}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(folder).withColumn("time", F.col("time").cast("timestamp"))
        made = make(stream)
        out = shared.workdir(spark, "told")
        timers.run(made, out, shared.workdir(spark, "state"))
        return spark.read.schema(made.schema).parquet(out).where("key <> ''")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@query(_CODES_SQL)
def stream_codes(spark, d):
    """The code filter of code_dedup_3s on a stream out of order."""
    folder, schema = _files(spark, d, F.col("event_type").alias("code"))
    told = _streamed(spark, folder, schema, lambda s: timers.over_stream(s, timers.Codes(3000), DELAY))
    return told.select(F.col("key").alias("camera"), "code", "at")


@query(f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) // 1000 AS ms, event_id, event_type IN ('error', 'view', 'click') AS hidden FROM events),
b AS (SELECT *, sum(CAST(NOT hidden AS INTEGER)) OVER (PARTITION BY key ORDER BY ms, event_id) AS block FROM e),
r AS (SELECT key, block, min(ms) FILTER (WHERE hidden) AS since, min(ms) FILTER (WHERE NOT hidden) AS shown FROM b GROUP BY key, block), n AS (SELECT *, lead(shown) OVER (PARTITION BY key ORDER BY block) AS nxt FROM r)
SELECT key, since + {6 * HOUR} AS "at", true AS locked FROM n WHERE since IS NOT NULL AND (nxt IS NULL OR nxt >= since + {6 * HOUR})""")
def stream_lock(spark, d):
    """A library that is hidden for six hours locks then, whether or not its user comes back."""
    folder, schema = _files(spark, d, F.col("event_type").isin("error", "view", "click").alias("hidden"))
    return _streamed(spark, folder, schema, lambda s: timers.over_stream(s, timers.Lock(6 * HOUR), DELAY))


@query(f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) // 1000 AS ms, event_id, event_type IN ('purchase', 'signup') AS ok FROM events),
b AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER w AS block, lead(ms) OVER w AS nxt FROM e WINDOW w AS (PARTITION BY key ORDER BY ms, event_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY key, block ORDER BY ms, event_id) AS n FROM b WHERE NOT ok), u AS (SELECT *, CASE WHEN n < 2 THEN 0 ELSE CAST(least({HOUR} * pow(2, least(n - 2, 40)), {48 * HOUR}) AS BIGINT) END AS wait FROM f)
SELECT key, ms AS "at", CAST(n AS INTEGER) AS failures, ms + wait AS until FROM u UNION ALL SELECT key, ms + wait, CAST(n AS INTEGER), NULL FROM u WHERE wait > 0 AND (nxt IS NULL OR nxt >= ms + wait)""")
def stream_backoff(spark, d):
    """Failures with when the next try is allowed, and that time itself where nothing was tried before."""
    folder, schema = _files(spark, d, F.col("event_type").isin("purchase", "signup").alias("ok"))
    return _streamed(spark, folder, schema, lambda s: timers.over_stream(s, timers.Backoff(2, HOUR, 48 * HOUR), DELAY))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g) SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last, count(*) AS n FROM s GROUP BY user_id, run""")
def stream_sessions(spark, d):
    """The runs of runs_with_tolerance as sessions on a stream."""
    folder, schema = _files(spark, d)
    found = _streamed(spark, folder, schema, lambda s: timers.sessions(s, "6 hours", DELAY))
    return found.select("key", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "n")


@query(_NEAREST_SQL)
def ingest_repeats(spark, d):
    """Vectors appended by batches, each checked against the five before it under its label, and one batch sent twice."""
    e = table(spark, d, "embeddings").select(F.col("label").alias("doc"), F.col("vec_id").alias("id"), F.col("embedding").alias("item"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    job = ingest.Repeats(spark, shared.workdir(spark, "ingest"), lambda x, y: dot(x, y) / F.sqrt(dot(x, x) * dot(y, y)) >= 0.3, "int", "long", "array<float>", most=5)
    cut = e.approxQuantile("id", [0.3, 0.6], 0.01)
    batch = sum(((F.col("id") > c).cast("int") for c in cut), F.lit(0))
    for k in (0, 1, 1, 2):
        job.batch(e.where(batch == k), k)
    return job.pages.scan().where("repeats IS NOT NULL").select(F.col("id").alias("vec_id"), F.col("repeats").alias("twin"))

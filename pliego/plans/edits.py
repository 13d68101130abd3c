"""Queries that replay commands, one made from each event, over conversations as documents; their SQL does them one after the other by recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import replay
from .catalogue import query

#: A page that an event adds has the event's number and this.
ADDED = 10_000_000

#: The command of each event: about 95 follow each other on a document, some documents are missing; two documents, next to each other, share moves.
_COMMANDS = f"""
SELECT e AS seq, d AS doc, e AS now, o AS other, CASE e % 11 WHEN 2 THEN 'insert_at' WHEN 3 THEN 'insert_after' WHEN 4 THEN 'move' WHEN 5 THEN 'trash_pages' WHEN 6 THEN 'restore_page' WHEN 7 THEN 'reorder' WHEN 8 THEN 'delete_pages'
WHEN 9 THEN CASE WHEN event_type = 'error' THEN 'trash' ELSE 'restore' END WHEN 10 THEN 'move' ELSE 'append' END AS kind,
CASE e % 11 WHEN 4 THEN {{list}}(d * 1000 + e % 8, {ADDED} + e - 4) WHEN 5 THEN {{list}}(d * 1000 + e % 4, {ADDED} + e - 4) WHEN 6 THEN {{list}}(CASE WHEN e % 3 = 0 THEN {ADDED} + e - 5 ELSE d * 1000 + e % 4 END) WHEN 7 THEN {{list}}({ADDED} + e - 7, d * 1000 + 2, d * 1000)
WHEN 8 THEN {{list}}({ADDED} + e - 8, d * 1000 + e % 6) WHEN 10 THEN {{list}}({ADDED} + e - 8, d * 1000 + 1) ELSE {{list}}({ADDED} + e) END AS pages,
CAST(e % 7 AS INT) AS at, d * 1000 + e % 5 AS anchor FROM (SELECT event_id AS e, {{doc}} AS d, CASE WHEN {{doc}} % 2 = 0 THEN {{doc}} + 1 ELSE {{doc}} - 1 END AS o, event_type FROM {{events}})
"""


def commands(spark, d: str) -> DataFrame:
    sql = _COMMANDS.format(list="array", doc="(event_id DIV 95)", events="{events}")
    return spark.sql(sql, events=spark.read.parquet(f"{d}/events.parquet"))


def store(spark, d: str) -> tuple[DataFrame, DataFrame]:
    pages = spark.read.parquet(f"{d}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("doc_id"), F.lit(None).cast("struct<cuando:bigint,lugar:int>").alias("papelera"), "text")
    docs = pages.groupBy(F.col("doc_id").alias("id")).agg(F.sort_array(F.collect_list("id")).alias("paginas")).withColumns({"modificado": F.lit(-1).cast("long"), "papelera": F.lit(None).cast("long")})
    return docs, pages


#: Two documents are a row of the recursion: a is the command's document, b the other. Steps put their arrays into h.
_STATE = f"""
WITH RECURSIVE cmd AS (SELECT *, doc // 2 AS g, row_number() OVER (PARTITION BY doc // 2 ORDER BY seq) AS n FROM ({_COMMANDS.format(list="list_value", doc="(event_id // 95)", events="events")})),
own AS (SELECT conv_id AS doc, list(conv_id * 1000 + turn ORDER BY turn) AS p FROM conversations GROUP BY conv_id),
g AS (SELECT DISTINCT doc // 2 AS g FROM (SELECT doc FROM own UNION ALL SELECT doc FROM cmd)),
s AS (SELECT g.g, CAST(0 AS BIGINT) AS n, x.p IS NOT NULL AS x0, y.p IS NOT NULL AS x1, coalesce(x.p, CAST([] AS BIGINT[])) AS p0, coalesce(y.p, CAST([] AS BIGINT[])) AS p1, CAST(-1 AS BIGINT) AS m0, CAST(-1 AS BIGINT) AS m1,
CAST(NULL AS BIGINT) AS t0, CAST(NULL AS BIGINT) AS t1, CAST([] AS STRUCT(page BIGINT, cuando BIGINT, lugar BIGINT)[]) AS k0, CAST([] AS STRUCT(page BIGINT, cuando BIGINT, lugar BIGINT)[]) AS k1, CAST([] AS BIGINT[][]) AS h0, CAST([] AS BIGINT[][]) AS h1
FROM g LEFT JOIN own x ON x.doc = 2 * g.g LEFT JOIN own y ON y.doc = 2 * g.g + 1
UNION ALL SELECT g, n, x0, x1, CASE WHEN left_ THEN na ELSE nb END, CASE WHEN left_ THEN nb ELSE na END,
CASE WHEN CASE WHEN left_ THEN step_a ELSE step_b END OR left_ AND xa AND kind = 'restore' THEN now ELSE m0 END, CASE WHEN CASE WHEN left_ THEN step_b ELSE step_a END OR NOT left_ AND xa AND kind = 'restore' THEN now ELSE m1 END,
CASE WHEN left_ AND xa AND kind = 'trash' THEN now WHEN left_ AND xa AND kind = 'restore' THEN NULL ELSE t0 END, CASE WHEN NOT left_ AND xa AND kind = 'trash' THEN now WHEN NOT left_ AND xa AND kind = 'restore' THEN NULL ELSE t1 END,
CASE WHEN left_ THEN nk ELSE k0 END, CASE WHEN left_ THEN k1 ELSE nk END,
CASE WHEN CASE WHEN left_ THEN step_a ELSE step_b END THEN list_append(h0, p0)[-4:] ELSE h0 END, CASE WHEN CASE WHEN left_ THEN step_b ELSE step_a END THEN list_append(h1, p1)[-4:] ELSE h1 END
FROM (SELECT *, xa AND (kind IN ('append', 'insert_at', 'insert_after', 'delete_pages', 'reorder', 'trash_pages') OR kind = 'move' AND xb OR kind = 'restore_page' AND kept IS NOT NULL) AS step_a, xa AND xb AND kind = 'move' AS step_b,
CASE WHEN NOT xa THEN a WHEN kind = 'append' THEN list_append(a, pages[1]) WHEN kind = 'insert_at' THEN list_concat(list_append(a[:"at"], pages[1]), a["at" + 1:])
WHEN kind = 'insert_after' THEN CASE WHEN list_contains(a, anchor) THEN list_concat(list_append(a[:list_position(a, anchor)], pages[1]), a[list_position(a, anchor) + 1:]) ELSE list_append(a, pages[1]) END
WHEN kind IN ('delete_pages', 'trash_pages') OR kind = 'move' AND xb THEN list_filter(a, lambda x: NOT list_contains(pages, x))
WHEN kind = 'reorder' THEN list_concat(list_filter(pages, lambda x: list_contains(a, x)), list_filter(a, lambda x: NOT list_contains(pages, x)))
WHEN kind = 'restore_page' AND kept IS NOT NULL AND NOT list_contains(a, pages[1]) THEN list_concat(list_append(a[:kept.lugar], pages[1]), a[kept.lugar + 1:]) ELSE a END AS na,
CASE WHEN xa AND xb AND kind = 'move' THEN list_concat(b, list_filter(a, lambda x: list_contains(pages, x))) ELSE b END AS nb,
CASE WHEN kind IN ('delete_pages', 'restore_page') THEN list_filter(k, lambda x: NOT list_contains(pages, x.page))
WHEN xa AND kind = 'trash_pages' THEN list_concat(k, list_transform(list_filter(a, lambda x: list_contains(pages, x)), lambda x: struct_pack(page := x, cuando := now, lugar := list_position(a, x) - 1))) ELSE k END AS nk
FROM (SELECT *, list_filter(k, lambda x: x.page = pages[1])[1] AS kept FROM (SELECT s.* EXCLUDE (n), c.n, c.kind, c.now, c.pages, c."at", c.anchor, c.doc % 2 = 0 AS left_, CASE WHEN c.doc % 2 = 0 THEN p0 ELSE p1 END AS a, CASE WHEN c.doc % 2 = 0 THEN p1 ELSE p0 END AS b,
CASE WHEN c.doc % 2 = 0 THEN x0 ELSE x1 END AS xa, CASE WHEN c.doc % 2 = 0 THEN x1 ELSE x0 END AS xb, CASE WHEN c.doc % 2 = 0 THEN k0 ELSE k1 END AS k FROM s JOIN cmd c ON s.g = c.g AND c.n = s.n + 1)))),
last AS (SELECT * FROM s QUALIFY n = max(n) OVER (PARTITION BY g)),
z AS (SELECT 2 * g AS id, p0 AS p, m0 AS m, t0 AS t, k0 AS k, h0 AS h FROM last WHERE x0 UNION ALL SELECT 2 * g + 1, p1, m1, t1, k1, h1 FROM last WHERE x1)
"""


def _shown(items) -> F.Column:
    return F.concat(F.lit("["), F.array_join(items.cast("array<string>"), ", "), F.lit("]"))


@query(_STATE + "SELECT id, CAST(p AS VARCHAR) AS pages, m AS changed, t AS trashed FROM z")
def replay_documents(spark, d):
    """Documents after a command for each event."""
    docs, pages = store(spark, d)
    docs = replay.replayed(docs, pages, commands(spark, d))
    return docs.select("id", _shown(F.col("paginas")).alias("pages"), F.col("modificado").alias("changed"), F.col("papelera").alias("trashed"))


@query(_STATE + "SELECT x.page AS id, id AS doc_id, x.cuando AS went, x.lugar AS place FROM (SELECT id, unnest(k) AS x FROM z)")
def replay_trash(spark, d):
    """Pages in the trash after a command for each event, with the documents that they are of, when they went and where they stood.

    From document 10,000 on pages that events add have the numbers of other documents' turns; the trash of each document is its own.
    """
    docs, pages = store(spark, d)
    return replay.trashed(docs, pages, commands(spark, d)).select("id", "doc_id", F.col("cuando").alias("went"), F.col("lugar").cast("long").alias("place"))


@query(_STATE + "SELECT id, CAST(CASE WHEN len(h) = 0 THEN p ELSE h[greatest(1, len(h) - 2)] END AS VARCHAR) AS pages FROM z")
def undo_steps(spark, d):
    """Documents' arrays before the last three steps of each, after a command for each event."""
    docs, pages = store(spark, d)
    docs = replay.replayed(docs, pages, commands(spark, d), keep=4)
    return replay.undone(docs, 3).select("id", _shown(F.col("paginas")).alias("pages"))

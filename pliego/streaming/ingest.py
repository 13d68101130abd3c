"""Jobs on streams that write to keyed logs: pages checked for repeats as they come, and purges. A batch that runs again after a failure changes nothing.

Spark gives a batch the same number and rows when it runs again, so the number is the commit key: each log notes the last one of each stream in the version that has
its rows. What a batch needs of earlier ones is a document's last pages, a log of its own with one row a document, so a batch costs what it brings, however long documents are. The
pages' log is written first: if the job ends between the two, the batch runs again from the same last pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import library
from ..sources.keylog import KeyLog
from ..sources.shared import written


class Repeats:
    """Appends pages (doc, id, item) to a log with the page among the `most` before it that each repeats, the nearest, if any.

    doc, id, item: types of a document's and a page's id and of what alike(item, earlier item) compares. Pages without an item take a place but repeat nothing. Within a batch, pages come in order of id.
    """

    def __init__(self, spark: SparkSession, root: str, alike: Callable[[Column, Column], Column], doc: str = "string", page: str = "string", item: str = "array<double>", most: int = 3, stream: str = "pages"):
        self.alike, self.most, self.stream = alike, most, stream
        self.pages = KeyLog(spark, f"{root}/pages", f"id {page}, doc {doc}, place long, item {item}, repeats {page}", "id", indexed=("doc",))
        self.tails = KeyLog(spark, f"{root}/tails", f"doc {doc}, place long, last array<struct<place:bigint,id:{page},item:{item}>>", "doc")

    def batch(self, rows: DataFrame, number: int) -> None:
        if self.tails.done(self.stream) >= number:
            return
        new = written(rows.select("doc", "id", "item"), "batch")
        docs = new.select("doc").distinct()
        tails = written(self.tails.lookup_many(docs), "tails")
        placed = library.numbered(new, "doc", "id").join(tails.select(F.col("doc").alias("_doc"), F.col("place").alias("_place")), F.col("doc").eqNullSafe(F.col("_doc")), "left")
        placed = placed.select("doc", "id", "item", (F.coalesce("_place", F.lit(0)) + F.col("n")).alias("place"))
        before = tails.select("doc", F.explode("last").alias("x")).select("doc", "x.id", "x.item", "x.place")
        twins = library.nearest_previous(placed.unionByName(before), "doc", "place", "id", "item", self.alike, self.most)
        twins = twins.select(F.col("id").alias("_id"), F.col("twin").alias("repeats"))
        placed = written(placed.join(twins, F.col("id") == F.col("_id"), "left").drop("_id"), "placed")
        self.pages.write(placed, batch=(self.stream, number))
        top = placed.groupBy("doc").agg(F.max("place").alias("top"))
        near = placed.select("doc", "place", "id", "item").unionByName(before.select("doc", "place", "id", "item")).join(top.withColumnRenamed("doc", "_doc"), F.col("doc").eqNullSafe(F.col("_doc")))
        near = near.where(F.col("place") > F.col("top") - self.most)
        last = near.groupBy("doc").agg(F.max("place").alias("place"), F.sort_array(F.collect_list(F.struct("place", "id", "item"))).alias("last"))
        self.tails.write(last, batch=(self.stream, number))

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """Follows a stream of (doc, id, item)."""
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def purge(log: KeyLog, now: int, trashed: str = "papelera", batch: tuple[str, int] | None = None) -> int:
    """Removes rows that were trashed over thirty days ago."""
    old = log.scan().where(dates.expired(F.col(trashed), F.lit(now)))
    return log.write(gone=old.select(log.key), batch=batch)


def start_purges(clock: DataFrame, log: KeyLog, checkpoint: str, trashed: str = "papelera", stream: str = "purge", **trigger):
    """Purges at each batch of a stream of times (now, in milliseconds), such as the rate source's."""

    def batch(rows: DataFrame, number: int) -> None:
        now = rows.agg(F.max("now")).first()[0]
        if now is not None:
            purge(log, now, trashed, (stream, number))

    return clock.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

"""Queries over a keyed log that is made of orders in several batches, compacted in between; their SQL does without a log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import keylog, shared
from .catalogue import query, table

SCHEMA = "o_orderkey long, o_custkey long, status string"


def _log(spark, d) -> keylog.KeyLog:
    """All orders; then finished ones again, of another status and some of another customer; urgent ones go; last, of those, the cheap ones come back."""
    log = keylog.KeyLog(spark, shared.workdir(spark, "keylog"), SCHEMA, "o_orderkey", buckets=8, indexed=("o_custkey",))
    orders = table(spark, d, "orders").withColumn("status", F.col("o_orderstatus"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    log.write(orders)
    log.write(orders.where("o_orderstatus = 'F'").withColumns({"status": F.lit("U"), "o_custkey": F.when(F.col("o_totalprice") > 200_000, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))}))
    log.write(gone=orders.where(urgent))
    log.compact(3)
    log.write(orders.where(urgent & (F.col("o_totalprice") < 100_000)).withColumn("status", F.lit("B")))
    return log


_ORDERS = """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey WHEN o_orderstatus = 'F' AND o_totalprice > 200000 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey,
CASE WHEN o_orderpriority = '1-URGENT' THEN 'B' WHEN o_orderstatus = 'F' THEN 'U' ELSE o_orderstatus END AS status FROM orders WHERE o_orderpriority <> '1-URGENT' OR o_totalprice < 100000) """


@query(_ORDERS + "SELECT * FROM o")
def log_scan(spark, d):
    """The whole table as its log has it."""
    return _log(spark, d).scan()


@query(_ORDERS + "SELECT * FROM o WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'R')")
def log_lookup(spark, d):
    """Rows of many keys."""
    keys = table(spark, d, "lineitem").where("l_quantity = 50 AND l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return _log(spark, d).lookup_many(keys)


@query(_ORDERS + "SELECT * FROM o WHERE o_custkey = (SELECT max(o_custkey) FROM o) OR o_orderkey = (SELECT max(o_orderkey) FROM o)")
def log_index(spark, d):
    """The last customer's orders through the index by customer, and the last order by its key."""
    log = _log(spark, d)
    last = log.scan().agg(F.max("o_custkey").alias("c"), F.max("o_orderkey").alias("k")).first()
    return log.by_index("o_custkey", last.c).unionByName(log.lookup(last.k)).distinct()


@query(_ORDERS + "SELECT * FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def log_cascade(spark, d):
    """What stays when all orders of some customers go, found through the index."""
    log = _log(spark, d)
    log.delete_by_index("o_custkey", table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")))
    log.compact(everything=True)
    return log.scan()

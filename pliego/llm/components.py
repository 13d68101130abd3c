"""Connected components of an edge table, by large-star and small-star rounds; nothing gathers on the driver.

Each round writes its edges to the shared folder, so the lineage stays short and a lost executor costs one round at most.
A node's least neighbour comes from an aggregate that combines before its shuffle. It is written, then goes back by a join of two plain
exchanges, which adaptive execution splits for a node with very many links, so that node is no single task's work. Rounds grow with the logarithm of a
component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, remove


def _down(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> tuple[DataFrame, str]:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least, path = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return _down(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))), path


def _small_star(edges: DataFrame) -> tuple[DataFrame, str]:
    least, path = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _down(moved.unionByName(least.select("u", F.col("m").alias("v")))), path


def _stars(edges: DataFrame) -> bool:
    """Whether every node points to one other that points to none: then roots are found."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    return ends.groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a > 1 OR a > 0 AND b > 0").isEmpty()


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, root) for every node of an edge; root is the least node of its component. Both columns are longs."""
    spark = edges.sparkSession
    e, path = materialize(_down(edges.select(F.col(u).alias("u"), F.col(v).alias("v"))), "edges")
    while not _stars(e):
        for star in (_large_star, _small_star):
            turned, least = star(e)
            e, new = materialize(turned, "edges")
            remove(spark, path)
            remove(spark, least)
            path = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def named(classes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """classes (key, least, ...) with root, the least key that edges (a, b) reach, and component_id, the smallest `least` there.

    Names are written before they are joined back, one row for each component that edges make: both sides of that join are then plain
    exchanges, which adaptive execution splits where one component holds very many classes.
    """
    roots, _ = materialize(components(edges, "a", "b").select(F.col("node").alias(key), "root"), "roots")
    names, _ = materialize(roots.join(classes.select(key, "least"), key).groupBy("root").agg(F.min("least").alias("component_id")), "names")
    out = classes.join(roots, key, "left").withColumn("root", F.coalesce("root", key)).join(names, "root", "left")
    # A component whose ids are all null has no name, and its classes have no id either.
    return out.withColumn("component_id", F.coalesce("component_id", "least"))

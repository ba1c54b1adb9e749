"""Connected components by alternating large-star and small-star steps.

Each step moves edges to a node's smallest neighbour by an aggregation and a
join on the node; no group's members are ever gathered. Hub nodes are only hot
join keys, which AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, new_path


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    moved = both.filter("b > a").join(_least(both), "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = _least(edges)
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a > b")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node of each component, for every node of an
    edge. Edges are two columns of longs; loops, repeats and both directions
    are fine. Runs until a round changes nothing."""
    spark = edges.sparkSession
    x, y = F.col(a), F.col(b)
    now = edges.filter(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    path, sign = "", None
    while True:
        to = new_path(spark, "components")
        now.write.parquet(to)
        if path:
            drop_path(spark, path)
        path, edges = to, spark.read.schema("a bigint, b bigint").parquet(to)
        found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == sign or not found[0]:
            break
        sign = tuple(found)
        now = _small_star(_large_star(edges).distinct()).distinct()
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)

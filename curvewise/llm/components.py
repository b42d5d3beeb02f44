"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvewise.session import stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour or itself."""
    near = _both_ways(edges)
    low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
    return near.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    ties = down.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return ties.unionByName(low.select("a", F.col("m").alias("b")))


def connected(edges: DataFrame) -> DataFrame:
    """Columns node and root (the smallest node reachable) for every node of an edge.

    `edges` has columns a and b of one orderable type; loops and repeats do not matter. All
    steps are joins and map-combined minima; a node with very many edges is only a join key,
    which Spark splits. It runs until nothing changes, about log(nodes) rounds.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        star = stored(_small_star(_large_star(now)).where("a <> b").distinct())
        state = star.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("decimal(38,0)")), F.max(F.xxhash64("a", "b"))).first()
        now = star
        if state == seen:
            break
        seen = state
    roots = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())

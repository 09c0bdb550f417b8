"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """edges: a, b (64-bit). Returns node, root (the least node of its component) for every node that is not a root itself.

    Each round points nodes at the least neighbour known, until all point at roots; a round's table is written to the
    shared folder, and only whether it is the last reaches the driver. Joins on a busy node are plain equi-joins that Spark
    may split.
    """
    now, turn = edges.filter("a <> b"), 0
    while True:
        # Large star: every neighbour above a node is pointed at the least of the node and its neighbours.
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")
        # Small star: a node and its lower neighbours are pointed at the least of them.
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(lowest).distinct()
        turn += 1
        now = scratch.write(small, f"{name}{turn}")
        scratch.drop(f"{name}{turn - 1}") if turn > 1 else None
        ends = now.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))

"""Connected components of an edge table, by alternating minimum-label hooking, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def connected_components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """node, component (its lowest node) for every node of edges (u long, v long).

    Each round points every node to the lowest neighbour (large star), then
    every node's higher neighbours to the lowest (small star), until all edges
    are stars.  Minima are combined before the shuffle, and the joins are plain
    equi-joins that the engine can split, so a node with very many edges is no
    bottleneck.  The rounds are cut in the shared checkpoint folder.
    """
    flat = durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(most_rounds):
        both = flat.unionByName(flat.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: neighbours not above the node, all pointed to the lowest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        new = durable(small.where("u <> v").distinct())
        # stars: no node is both a leaf and a centre, and each leaf has one centre
        n, leaves = new.agg(F.count("*"), F.count_distinct("u")).first()
        if n == leaves and new.select("u").join(new.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            centres = new.select(F.col("v").alias("u")).distinct()
            return new.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres.select(F.col("u").alias("node"), F.col("u").alias("component")))
        flat = new
    raise RuntimeError("components did not settle")

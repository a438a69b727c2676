"""Connected components of links between numbers, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pricetrail.session import cut


def connected_components(links: DataFrame) -> DataFrame:
    """``a, b`` to ``node, component``: every node of a link and the smallest node it reaches.

    In each round nodes hand their smallest neighbour to the larger ones around, then to the smaller
    ones; both are grouped minima and joins by node, so no neighbourhood is collected. Rounds grow with
    the logarithm of the longest chain, and each is written, so a lost executor repeats one round.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    before = None
    while True:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        larger = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        below = larger.groupBy("a").agg(F.min("b").alias("m"))
        edges = cut(larger.join(below, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    low = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    return nodes.join(low, "node", "left").select("node", F.coalesce("m", "node").alias("component"))

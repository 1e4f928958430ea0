"""Connected components of a link table, by alternating large-star and small-star rounds, with a cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, rounds: int = 1000) -> DataFrame:
    """node, component (the smallest node reachable) for every node of links(a, b); isolated nodes do not appear.

    Each round is two aggregations and two joins by node. The aggregates are cut off before they are joined, so the joins are
    plain inner joins of two exchanges, which adaptive execution splits where a node has very many links. Rounds end when one changes nothing; their number grows with the logarithm of the
    longest shortest path, so `rounds` is out of reach: if it is met all the same, that is an error, and no links are lost.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut(edges)
    mark = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u")
        edges = cut(small.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("component"))
    return roots.select(F.col("u").alias("node"), "component").union(roots.select(F.col("component").alias("node"), "component").distinct())

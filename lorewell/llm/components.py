"""Connected components of a graph whose edges stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop_table


def _nearest(edges: DataFrame, name: str) -> DataFrame:
    """The smallest neighbour of each `u`; a table of its own, so that the join below is one that Spark can split."""
    return cut(edges.groupBy("u").agg(F.min("v").alias("m")), name)


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b): root is the smallest node it can reach.

    Alternates large-star and small-star steps: each node hands its neighbours its smallest one, until the edges
    are stars around the roots. The number of steps grows with the logarithm of the graph's size. Minima are
    partly aggregated before they are shuffled, and a node with very many edges meets its minimum in a sort-merge
    join whose large partitions Spark splits. Every step starts from a written table. Loops and repeated edges do
    no harm; rows with a null are ignored; no edges give no rows.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = _nearest(both, "nearest")
        large = both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = cut(large, "large-star")
        drop_table(now)
        drop_table(near)
        near = _nearest(large, "nearest")
        moved = large.join(near, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(moved.union(near.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        drop_table(large)
        drop_table(near)
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if sums == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
        state = sums

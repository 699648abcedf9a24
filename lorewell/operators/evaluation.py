"""Retrieval quality: ranks, ablations, sweeps, recall and agreement of orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranks(expected: DataFrame, results: DataFrame) -> DataFrame:
    """query_id, category, rank of the expected id among a query's results; null if it isn't there."""
    hits = results.join(expected.select("query_id", "id"), ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return expected.select("query_id", "category").distinct().join(hits, "query_id", "left")


def quality(ranked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """queries, found, mrr, hit@1, 3, 5, 10, over all or by columns; what isn't found counts as zero."""
    hit = lambda k: F.round(F.count_if(F.col("rank") <= k) / F.count("*"), 6).alias(f"hit_{k}")
    mrr = F.round(F.sum(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))) / F.count("*"), 6)
    return ranked.groupBy(*(by or [])).agg(F.count("*").alias("queries"), F.count("rank").alias("found"), mrr.alias("mrr"), *map(hit, (1, 3, 5, 10)))


def ablation(metrics: DataFrame, base: str) -> DataFrame:
    """condition, mrr, delta, place: each condition against the base, the largest change first."""
    full = metrics.where(F.col("condition") == base).select(F.col("mrr").alias("_base"))
    place = F.row_number().over(Window.orderBy(F.desc(F.abs("delta")), "condition"))
    return metrics.where(F.col("condition") != base).join(F.broadcast(full)).withColumn("delta", F.round(F.col("mrr") - F.col("_base"), 6)).withColumn("place", place).drop("_base")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """change, n: how many queries' ranks improved, degraded or stayed; absence is worse than any rank."""
    far = 1_000_000
    a, b = F.coalesce("before", F.lit(far)), F.coalesce("after", F.lit(far))
    change = F.when(b < a, "improved").when(b > a, "degraded").otherwise("same")
    joined = before.select("query_id", F.col("rank").alias("before")).join(after.select("query_id", F.col("rank").alias("after")), "query_id")
    return joined.groupBy(change.alias("change")).agg(F.count("*").alias("n"))


def sweep(scored: DataFrame, weights: DataFrame, expected: DataFrame) -> DataFrame:
    """weight, mrr over all queries when `extra` is added with that weight to `base`: (query_id, id, base, extra).

    The weights are a handful of stated values; every pool is scored under each of them in one plan.
    """
    order = Window.partitionBy("weight", "query_id").orderBy(F.desc(F.round(F.col("base") + F.col("weight") * F.col("extra"), 9)), "id")
    placed = scored.join(F.broadcast(weights)).withColumn("rank", F.row_number().over(order))
    hits = placed.join(expected.select("query_id", "id"), ["query_id", "id"], "left_semi").groupBy("weight", "query_id").agg(F.min("rank").alias("rank"))
    n = expected.select("query_id").distinct().agg(F.count("*").alias("n"))
    return hits.groupBy("weight").agg(F.sum(1.0 / F.col("rank")).alias("s")).join(F.broadcast(n)).select("weight", F.round(F.col("s") / F.col("n"), 6).alias("mrr"))


def search(signals: DataFrame, weights: DataFrame, expected: DataFrame, score: Column) -> DataFrame:
    """name, mrr of each of a few stated sets of weights: every pool is scored under each of them in one plan.

    A caller that searches further makes the next sets from the best of these.
    """
    order = Window.partitionBy("name", "query_id").orderBy(F.desc(F.round(score, 6)), "id")
    placed = signals.join(F.broadcast(weights)).withColumn("rank", F.row_number().over(order))
    hits = placed.join(expected.select("query_id", "id"), ["query_id", "id"], "left_semi").groupBy("name", "query_id").agg(F.min("rank").alias("rank"))
    n = expected.select("query_id").distinct().agg(F.count("*").alias("n"))
    return hits.groupBy("name").agg(F.sum(1.0 / F.col("rank")).alias("s")).join(F.broadcast(n)).select("name", F.round(F.col("s") / F.col("n"), 6).alias("mrr"))


def consolidation(ranked: DataFrame, insights: DataFrame) -> DataFrame:
    """memory_id, outranks, gain: whether an insight stands above all its sources in a query's results, and by how
    much on average. insights: (query_id, memory_id, id of a source)."""
    own = ranked.select("query_id", F.col("id").alias("memory_id"), F.col("rank").alias("own"))
    sources = ranked.select("query_id", "id", F.col("rank").alias("theirs"))
    both = insights.join(own, ["query_id", "memory_id"]).join(sources, ["query_id", "id"])
    return both.groupBy("query_id", "memory_id").agg(F.bool_and(F.col("own") < F.col("theirs")).alias("outranks"), F.round(F.avg(F.col("theirs") - F.col("own")), 6).alias("gain"))


def recall(exact: DataFrame, approximate: DataFrame, k: int) -> DataFrame:
    """query_id, recall: the share of the exact top k that the approximate one has."""
    top = exact.where(F.col("rank") <= k)
    met = top.join(approximate.where(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return met.groupBy("query_id").agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


def kendall_tau(expected: DataFrame, returned: DataFrame) -> DataFrame:
    """query_id, tau of two orders (query_id, id, rank); -1 where the sets differ. Orders are short lists."""
    a, b = expected.select("query_id", "id", F.col("rank").alias("ra")), returned.select("query_id", "id", F.col("rank").alias("rb"))
    both = a.join(b, ["query_id", "id"], "full")
    lists = both.groupBy("query_id").agg(F.bool_and(F.col("ra").isNotNull() & F.col("rb").isNotNull()).alias("same"), F.collect_list(F.struct("ra", "rb")).alias("l"))
    sign = lambda x, y: F.signum((x["ra"] - y["ra"]) * (x["rb"] - y["rb"]))
    total = F.aggregate("l", F.lit(0.0), lambda s, x: s + F.aggregate("l", F.lit(0.0), lambda t, y: t + sign(x, y)))
    n = F.size("l")
    return lists.select("query_id", F.when(~F.col("same"), -1.0).when(n < 2, 1.0).otherwise(F.round(total / (n * (n - 1)), 6)).alias("tau"))

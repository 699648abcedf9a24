"""What is worth showing: insights, contradictions, rows to see again, and a reader's preferences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed order of the kinds.
PRIORITY = {"contradiction": 0, "insight": 1, "resurfaced": 2, "question": 3, "digest": 4}


def resurfaced(rows: DataFrame, as_of: str, older: int, n: int) -> DataFrame:
    """Active rows older than so many days that were used most, the most certain and oldest first."""
    old = rows.where((F.col("status") == "active") & (F.col("created_at") < F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(older))))
    return old.orderBy(F.desc("access_count"), F.desc("confidence"), "created_at", "id").limit(n)


def insights(candidates: DataFrame, memories: DataFrame) -> DataFrame:
    """memory_id, sources, projects, cross_project: created memories with what they were made from."""
    made = candidates.where("memory_id IS NOT NULL").select("memory_id", F.explode("source_ids").alias("id"))
    return made.distinct().join(memories.select("id", "project"), "id").groupBy("memory_id").agg(
        F.count("*").alias("sources"), F.array_join(F.array_sort(F.collect_set("project")), ",").alias("projects"), (F.countDistinct("project") > 1).alias("cross_project")
    )


def first_per_source(rows: DataFrame, source: str, order: list, fetch: int, n: int) -> DataFrame:
    """Of the first `fetch` rows the first of each source, and of these the first n: the limit comes before the choice."""
    head = rows.orderBy(*order).limit(fetch)
    return head.withColumn("_n", F.row_number().over(Window.partitionBy(source).orderBy(*order))).where("_n = 1").drop("_n").orderBy(*order).limit(n)


def preferred(items: DataFrame, preferences: DataFrame) -> DataFrame:
    """Items (kind, key, topic) without muted ones, with `weight`, the sum of what is left of the preferences.

    preferences: (target_type item / kind / topic, target_key, signal, weight), one for each target.
    """
    parts = []
    for target, column in (("item", "key"), ("kind", "kind"), ("topic", "topic")):
        parts.append(preferences.where(F.col("target_type") == target).select(F.col("target_key").alias(f"_{target}"), F.col("signal").alias(f"_{target}_signal"), F.col("weight").alias(f"_{target}_weight")))
        items = items.join(parts[-1], F.col(column) == F.col(f"_{target}"), "left")
    names = ("item", "kind", "topic")
    muted = F.greatest(*[F.coalesce(F.col(f"_{t}_signal") == "mute", F.lit(False)) for t in names])
    weight = sum((F.coalesce(F.col(f"_{t}_weight"), F.lit(0.0)) for t in names), F.lit(0.0))
    return items.where(~muted).withColumn("weight", weight).drop(*[f"_{t}{s}" for t in names for s in ("", "_signal", "_weight")])


def ranked(items: DataFrame, n: int) -> DataFrame:
    """The n items to show: kinds in their order, across projects first, by weight, then the newest."""
    kind = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("kind")]
    return items.orderBy(F.coalesce(kind, F.lit(99)), F.desc("cross_project"), F.desc("weight"), F.desc("created_at"), "key").limit(n)

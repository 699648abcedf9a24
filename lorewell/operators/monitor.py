"""Freshness, cadence and streaks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Age of a channel that never had a row.
NEVER = 99_999


def channel_ages(rows: DataFrame, policy: DataFrame, as_of: str) -> DataFrame:
    """channel, age (days since its newest row), overdue, of every channel in the policy (channel, max_age_days)."""
    newest = rows.groupBy(F.col("source_type").alias("channel")).agg(F.max("created_at").alias("newest"))
    age = F.coalesce(F.date_diff(F.lit(as_of).cast("date"), F.col("newest").cast("date")), F.lit(NEVER))
    return policy.join(newest, "channel", "left").select("channel", age.alias("age"), (age > F.col("max_age_days")).alias("overdue"))


def cadence(rows: DataFrame, key: str, floor: int = 2) -> DataFrame:
    """key, days, gap: the longest wait between days with rows, plus one, at least `floor`."""
    days = rows.select(key, F.col("created_at").cast("date").alias("day")).distinct()
    gap = F.date_diff("day", F.lag("day").over(Window.partitionBy(key).orderBy("day")))
    return days.withColumn("g", gap).groupBy(key).agg(F.count("*").alias("days"), F.greatest(F.lit(floor), F.coalesce(F.max("g"), F.lit(0)) + 1).alias("gap"))


def zero_streak(runs: DataFrame) -> DataFrame:
    """run_type, streak: the newest completed runs in a row that generated nothing."""
    newest_first = Window.partitionBy("run_type").orderBy(F.desc("started_at"), F.desc("run_id")).rowsBetween(Window.unboundedPreceding, 0)
    any_yet = F.max(F.when(F.col("generated") > 0, 1).otherwise(0)).over(newest_first)
    return runs.where("completed_at IS NOT NULL").withColumn("any", any_yet).groupBy("run_type").agg(F.count_if(F.col("any") == 0).alias("streak"))


def zero_output(rows: DataFrame, wanted: DataFrame, as_of: str, days: int) -> DataFrame:
    """type, last_day, silent: types of output without a row in the last days; those that never had one too."""
    last = rows.groupBy("type").agg(F.max(F.col("created_at").cast("date")).alias("last_day"))
    silent = F.coalesce(F.date_diff(F.lit(as_of).cast("date"), F.col("last_day")) > days, F.lit(True))
    return wanted.join(last, "type", "left").select("type", "last_day", silent.alias("silent"))


#: Deferrals in a row that make a strike.
DEFERRALS = 3


def strikes(outcomes: DataFrame, limit: int = 3, cool_days: int = 30) -> DataFrame:
    """key, strikes, cool_until after a fold over outcomes (key, at, outcome ok / deferred / too_short / any failure) in
    time order, as `strike` has it; outcomes that are null are passed over."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        state = START
        for at, outcome in group.sort_values(["at", "outcome"])[["at", "outcome"]].itertuples(index=False):
            state = strike(state, at, outcome, limit, cool_days)
        return pd.DataFrame({"key": [group["key"].iloc[0]], "strikes": [state[0]], "cool_until": [state[2]]}).astype({"cool_until": "datetime64[ns]"})

    return outcomes.where("outcome IS NOT NULL").select("key", "at", "outcome").groupBy("key").applyInPandas(fold, f"key {dict(outcomes.dtypes)['key']}, strikes long, cool_until timestamp_ntz")


#: Strikes, day of the last one, end of the cool-off, deferrals in a row.
START = (0, None, None, 0)


def strike(state: tuple, at, outcome: str, limit: int, cool_days: int) -> tuple:
    """The state after one outcome.

    A success clears it. A failure is a strike, one a day at most, and `limit` strikes or more start a cool-off from
    each further one; the count outlives the cool-off. Three deferrals in a row are a failure; any attempt ends their
    row. A text that is too short cools off at once and clears the count.
    """
    count, last, until, deferrals = state
    cool = at + pd.Timedelta(days=cool_days)
    if outcome == "ok":
        return START
    if outcome == "deferred" and deferrals + 1 < DEFERRALS:
        return count, last, until, deferrals + 1
    if outcome == "too_short":
        return 0, None, cool, 0
    if count and last == at.date():
        return count, last, until, 0
    return count + 1, at.date(), (cool if count + 1 >= limit else None), 0


def findings(*parts: DataFrame) -> DataFrame:
    """One report (check, subject, severity, detail) of all parts, the severe first."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.when(F.col("severity") == "error", 0).otherwise(1), "check", "subject")


def interaction_summary(events: DataFrame) -> DataFrame:
    """key, n, types, engaged, first_at, last_at of each item's interactions."""
    active = F.bool_or(F.col("event_type").isin("purchase", "click"))
    return events.groupBy("key").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"), active.alias("engaged"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def dwell(visits: DataFrame, cap: int) -> DataFrame:
    """day, url, host, seconds (each visit's at most the cap), visits, first_at, title (the first that isn't empty)."""
    named = F.when(F.col("title") != "", F.col("at"))
    return visits.groupBy(F.col("at").cast("date").alias("day"), "url", "host").agg(
        F.sum(F.least("seconds", F.lit(cap))).alias("seconds"), F.count("*").alias("visits"), F.min("at").alias("first_at"), F.min_by("title", F.when(named.isNotNull(), F.struct("at", "title"))).alias("title")
    )


def covering_backlog(arrivals: DataFrame, passes: DataFrame) -> DataFrame:
    """Arrivals (key, id, arrived_at, done_at) never done although a later one of the key was: skipped, not waiting."""
    latest = passes.groupBy("key").agg(F.max("arrived_at").alias("covered"))
    return arrivals.where("done_at IS NULL").join(latest, "key").where("arrived_at <= covered").select("key", "id", "arrived_at")

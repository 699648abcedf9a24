"""Structured Streaming counterparts of the operators that keep state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.monitor import START, strike


def distinct_arrivals(stream: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """Each identity once: repeats within the watermark's delay are dropped, as overlapping collections bring them."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def daily(stream: DataFrame, at: str, keys: list[str], late: str, zone: str = "UTC") -> DataFrame:
    """start, keys, n: counts of local days, which begin at midnight of the zone."""
    local = stream.withColumn("_local", F.from_utc_timestamp(F.col(at), zone)).withWatermark("_local", late)
    return local.groupBy(F.window("_local", "1 day").alias("day"), *keys).agg(F.count("*").alias("n")).select(F.col("day.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, at: str, key: str, gap: str, late: str) -> DataFrame:
    """Runs of a key's rows that are nowhere further apart than the gap."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("s"), key).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def use_counts(stream: DataFrame) -> DataFrame:
    """id, uses so far: what a writer adds to the stored counts."""
    return stream.groupBy("id").agg(F.count("*").alias("uses"))


def into_snapshots(counts: DataFrame, apply) -> DataStreamWriter:
    """Hands each batch to apply(batch, number); a number that was applied before is not applied again by it."""
    return counts.writeStream.outputMode("update").foreachBatch(lambda batch, number: apply(batch, number))


def strikes(stream: DataFrame, limit: int = 3, cool_days: int = 30) -> DataFrame:
    """key, strikes, cool_until after each batch's outcomes (key string, at, outcome); the state per key stays small.

    Rows of a key are folded in the order of their times within a batch, batches in the order they come.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, last, until, deferrals = state.get if state.exists else START
        now = (count, pd.Timestamp(last).date() if last else None, pd.Timestamp(until) if until else None, deferrals)
        rows = pd.concat(list(batches)).sort_values(["at", "outcome"])
        for at, outcome in rows[["at", "outcome"]].itertuples(index=False):
            now = strike(now, at, outcome, limit, cool_days)
        count, last, until, deferrals = now
        state.update((count, str(last) if last else None, str(until) if until is not None else None, deferrals))
        yield pd.DataFrame({"key": [key[0]], "strikes": [count], "cool_until": [str(until) if until is not None else None]})

    return stream.where("outcome IS NOT NULL").groupBy("key").applyInPandasWithState(fold, "key string, strikes long, cool_until string", "count long, last string, until string, deferrals long", "update", GroupStateTimeout.NoTimeout)

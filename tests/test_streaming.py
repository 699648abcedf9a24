import uuid

import pytest
from pyspark.sql import functions as F

from lorewell.operators import monitor
from lorewell.streaming import jobs


@pytest.fixture()
def replay(spark, tmp_path):
    def run(rows, make, mode, batches=3):
        """The result of a stream that gets the rows in so many files, in order of `n`."""
        path = tmp_path / uuid.uuid4().hex
        for k in range(batches):
            rows.where(F.pmod("part", F.lit(batches)) == k).drop("part").coalesce(1).write.mode("append").parquet(str(path))
        stream = spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(str(path))
        name = "t" + uuid.uuid4().hex
        q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path) + "-c").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert not q.exception()
        return spark.table(name)

    return run


@pytest.fixture(scope="module")
def events(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    return e.withColumn("at", F.col("ts").cast("timestamp")).withColumn("part", F.floor(F.col("event_id") / 400))


def test_distinct_arrivals(replay, events):
    twice = events.unionByName(events.withColumn("part", F.col("part")))
    got = replay(twice, lambda s: jobs.distinct_arrivals(s, ["event_id"], "at", "30 days"), "append")
    assert got.count() == events.count() == got.select("event_id").distinct().count()


def test_days_like_a_batch(replay, events):
    got = replay(events, lambda s: jobs.daily(s, "at", ["event_type"], "40 days"), "complete")
    want = events.groupBy(F.date_trunc("day", "at").alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sessions(replay, events):
    got = replay(events, lambda s: jobs.sessions(s, "at", "user_id", "2 hours", "1 hour"), "append")
    assert got.count() > 0 and got.agg(F.sum("n")).first()[0] <= events.count()


def test_use_counts(replay, events):
    got = replay(events.withColumn("id", F.col("user_id")), jobs.use_counts, "complete")
    assert {(r.id, r.uses) for r in got.collect()} == {(r.user_id, r["count"]) for r in events.groupBy("user_id").count().collect()}


def test_strikes_like_a_batch(replay, events):
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "ok").otherwise("deferred")
    rows = events.select(F.col("user_id").cast("string").alias("key"), F.col("ts").alias("at"), outcome.alias("outcome"), "part")
    got = replay(rows, jobs.strikes, "update", 4)
    last = {r.key: r.strikes for r in got.collect()}
    assert last == {r.key: r.strikes for r in monitor.strikes(rows).collect()}


def test_batches_go_to_snapshots(spark, events, tmp_path):
    seen = []
    path = str(tmp_path / "in")
    events.drop("part").write.parquet(path)
    stream = spark.readStream.schema(events.drop("part").schema).parquet(path).withColumn("id", F.col("user_id"))
    q = jobs.into_snapshots(jobs.use_counts(stream), lambda batch, n: seen.append((n, batch.agg(F.sum("uses")).first()[0]))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(n for _, n in seen) == events.count()

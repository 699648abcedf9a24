"""Cosines within a key by blocks against the column function pair by pair."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lorewell.operators import capture, reports, vectors

SCHEMA = "candidate_id long, label int, embedding array<float>"


def table(n, seed):
    draw = random.Random(seed)
    odd = [None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [1.0, 2.0], [math.nan, 1.0, 0.0], [math.inf, 0.0, 1.0], [1.0, 0.0, 0.0], [1.0, math.sqrt(3), 0.0], [3.0, 4.0, 0.0], [4.0, 3.0, 0.0]]
    return [(i, draw.choice([0, 0, 0, 1, 2, None]), draw.choice(odd) if draw.random() < 0.2 else [float(draw.randint(-3, 3)) for _ in range(3)]) for i in range(n)]


def by_pairs(candidates, stored, threshold):
    """What the two operators give, from all pairs of a key."""
    pairs = candidates.join(stored.where("embedding IS NOT NULL").select("label", F.col("embedding").alias("_b")), "label").groupBy("candidate_id").agg(F.max(vectors.cosine("embedding", "_b")).alias("s"))
    best = {r[0]: r[1] for r in pairs.collect()}
    earlier = candidates.select("label", F.col("candidate_id").alias("_e"), F.col("embedding").alias("_b"))
    twins = {r[0] for r in candidates.join(earlier, "label").where("_e < candidate_id").where(vectors.cosine("embedding", "_b") >= threshold).select("candidate_id").collect()}
    every = {r[0]: best.get(r[0], 0.0) for r in candidates.select("candidate_id").collect()}
    return every, {i for i, s in every.items() if s < threshold and i not in twins}


@pytest.mark.parametrize("threshold", [0.5, 0.96, 1.0, 0.0])
def test_blocks_give_what_pairs_give(spark, monkeypatch, threshold):
    monkeypatch.setattr(vectors, "SIDE", 16)
    monkeypatch.setattr(vectors, "STRIP", 5)
    rows = spark.createDataFrame(table(300, 3), SCHEMA).repartition(3)
    candidates, stored = rows.where("candidate_id % 3 = 0"), rows.where("candidate_id % 3 <> 0")
    every, new = by_pairs(candidates, stored, threshold)
    same = lambda a, b: a == b or (math.isnan(a) and math.isnan(b)) or abs(a - b) < 1e-12
    got = {r[0]: r[1] for r in capture.greatest_similarity(candidates, stored, "label").collect()}
    assert set(got) == set(every) and all(same(got[i], every[i]) for i in every)
    assert {r[0] for r in reports.new_items(candidates, stored, "label", threshold).collect()} == new


def test_no_pair_becomes_a_row(spark):
    rows = spark.createDataFrame(table(300, 4), SCHEMA)
    df = reports.new_items(rows.where("candidate_id % 3 = 0"), rows.where("candidate_id % 3 <> 0"), "label", 0.5)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan

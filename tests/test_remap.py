"""Merged rows' references against plain loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lorewell.operators import remap

MERGES = "old_id string, new_id string"


def ends(merges):
    to = dict(merges)

    def end(i):
        while i in to:
            i = to[i]
        return i

    return {i: end(i) for i in to}


def test_chains_end_where_a_walk_ends(spark):
    draw = random.Random(3)
    merges = [(f"n{i}", f"n{i + 1}") for i in range(300)] + [(f"t{i}", f"t{draw.randrange(i)}") for i in range(1, 400)] + [(f"h{i}", "n0") for i in range(200)]
    rows = spark.createDataFrame(merges + merges[:5] + [("n300", "n300"), (None, "n1"), ("n300", None)], MERGES)
    assert {r.id: r.survivor for r in remap.survivors(rows).collect()} == ends(merges)


def test_no_merges(spark):
    assert remap.survivors(spark.createDataFrame([], MERGES)).collect() == []


@pytest.mark.parametrize("merges", [[("a", "b"), ("b", "a")], [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("x", "y")], [("a", "b"), ("a", "c")]])
def test_circles_and_two_survivors_are_refused(spark, merges):
    with pytest.raises(ValueError):
        remap.survivors(spark.createDataFrame(merges, MERGES))


def test_every_kind_of_column(spark):
    draw = random.Random(5)
    to = {f"i{n}": f"i{n % 7}" for n in range(7, 60)}
    some = lambda: f"i{draw.randrange(80)}"
    values = []
    for n in range(200):
        text = json.dumps({"said \"i9\\": "i9", some(): [some(), {"at": some(), "prose": f"{some()} is no id"}], "n": 9}) if n % 5 else [None, "", "i9", "{broken \"i9\"", "[]"][n // 5 % 5]
        values.append((n % 150, some() if n % 4 else None, [some(), None, some(), some()] if n % 3 else None, f"{some()}:{some()}" if n % 6 else [None, "", "i9", "i9:"][n // 6 % 4], text))
    rows = spark.createDataFrame(values + values[:40], "n int, id string, list array<string>, key string, meta string").withColumn("_kind2", F.lit(1))
    pairs = spark.createDataFrame(list(to.items()), "id string, survivor string")
    got = [tuple(r) for r in remap.moved(rows, pairs, ids=("id",), arrays=("list",), keys=("key",), texts=("meta",)).collect()]

    def deep(v):
        if isinstance(v, dict):
            return {to.get(k, k): deep(x) for k, x in v.items()}
        return [deep(x) for x in v] if isinstance(v, list) else to.get(v, v) if isinstance(v, str) else v

    def parsed(t):
        try:
            return json.dumps(json.loads(t), sort_keys=True)
        except (TypeError, ValueError):
            return t

    def plain(n, i, items, key, text):
        try:
            text = json.dumps(deep(json.loads(text)))
        except (TypeError, ValueError):
            pass
        return (n, to.get(i, i), items and [to.get(x, x) for x in items], key if key is None else ":".join(to.get(p, p) for p in key.split(":")), parsed(text), 1)

    assert sorted(map(repr, ((*g[:4], parsed(g[4]), g[5]) for g in got))) == sorted(repr(plain(*v)) for v in values + values[:40])


def test_numbers_keep_their_type(spark):
    rows = spark.createDataFrame([(1, [1, 2, 2]), (3, []), (None, None)], "id long, list array<long>")
    to = spark.createDataFrame([(1, 9), (2, 9)], "id long, survivor long")
    out = remap.moved(rows, to, ids=("id",), arrays=("list",))
    assert out.schema == rows.schema and {(r.id, tuple(r.list) if r.list is not None else None) for r in out.collect()} == {(9, (9, 9, 9)), (3, ()), (None, None)}


def test_edges_append_notes_by_line(spark):
    rows = [("b", "x", "supports", "moved", "2024-01-01", "2024-05-01"), ("a", "x", "supports", "own", "2024-02-01", "2024-04-01"), ("a", "b", "supports", "self", "2024-01-01", None), ("x", "b", "related_to", None, "2024-01-03", None), ("a", "x", "related_to", None, "2024-01-02", "2024-02-01")]
    df = spark.createDataFrame(rows, "source_id string, target_id string, relation string, note string, created_at string, expired_at string")
    df = df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "expired_at")})
    got = {(r.source_id, r.target_id, r.relation): (r.note, str(r.created_at)[:10], str(r.expired_at)[:10], r.merged) for r in remap.edges(df, spark.createDataFrame([("b", "a")], "id string, survivor string")).collect()}
    assert got == {("a", "x", "supports"): ("own\nmoved", "2024-01-01", "2024-05-01", 2), ("a", "x", "related_to"): (None, "2024-01-02", "None", 2)}


def test_skims_of_a_survivor_and_a_model_are_one(spark):
    rows = spark.createDataFrame([("a", "m", 1), ("b", "m", 1), ("c", "m", 1), ("c", "m", 2), ("b", "m", 2), ("b", None, 1), ("z", "m", 1)], "memory_id string, model string, version int")
    got = {(r.old_id, r.model, r.version): (r.memory_id, r.archived) for r in remap.skims(rows, spark.createDataFrame([("b", "a"), ("c", "a")], "id string, survivor string")).collect()}
    assert got == {("a", "m", 1): ("a", False), ("b", "m", 1): ("a", True), ("c", "m", 1): ("a", True), ("c", "m", 2): ("a", True), ("b", "m", 2): ("a", False), ("b", None, 1): ("a", False), ("z", "m", 1): ("z", False)}


def test_feedback_takes_the_newest(spark):
    rows = [(1, "item", "a:x", "up", 1.0, "2024-01-01"), (2, "item", "b:x", "down", 2.0, "2024-02-01"), (3, "item", "c:x", "up", 3.0, "2024-02-01"), (4, "topic", "b", "up", 1.0, "2024-01-01"), (5, "item", "b", "up", 1.0, None), (6, "item", "xb", "up", 1.0, "2024-01-01")]
    df = spark.createDataFrame(rows, "id long, target_type string, target_key string, signal string, weight double, updated_at string").withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))
    got = {r.id: r for r in remap.feedback(df, spark.createDataFrame([("b", "a"), ("c", "a")], "id string, survivor string")).collect()}
    assert {i: (r.target_key, r.signal, r.weight, r.merged) for i, r in got.items()} == {1: ("a:x", "down", 2.0, 3), 4: ("b", "up", 1.0, 1), 5: ("a", "up", 1.0, 1), 6: ("xb", "up", 1.0, 1)}
    assert [x.target_key for x in got[1].archived] == ["a:x", "b:x", "c:x"] and got[4].archived is None

"""The kept vector index against plain cosines: filters, odd rows, updates, and recall that probing was set for."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell.operators import vector_index
from lorewell.sources.shared import shared_dir

SCHEMA = "id long, embedding array<float>, label int, list string"


@pytest.fixture
def path(spark):
    return f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"


def frame(spark, vectors, labels=None):
    rows = [(i, None if v is None else [float(x) for x in v], (labels or {}).get(i, i % 3)) for i, v in vectors.items()]
    return spark.createDataFrame(rows, "id long, embedding array<float>, label int")


def exact(vectors, queries, k, keep=lambda i: True):
    unit = lambda v: np.asarray(v, np.float32).astype(float) / (np.linalg.norm(np.asarray(v, np.float32).astype(float)) or 1)
    out = {}
    for q, v in queries.items():
        scored = sorted((-float(unit(v) @ unit(w)), i) for i, w in vectors.items() if keep(i))
        out[q] = [i for _, i in scored[:k]]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.id))
    return {q: [i for _, i in sorted(x)] for q, x in out.items()}


def asked(spark, queries):
    return spark.createDataFrame([(q, [float(x) for x in v]) for q, v in queries.items()], "query_id long, embedding array<float>")


def test_search_filters_and_updates(spark, path):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 10)) * 3
    vectors = {i: centres[i % 12] + rng.standard_normal(10) for i in range(1500)}
    odd = {5000: None, 5001: [float("nan")] * 10, 5002: [], 5003: [1.0, 2.0]}
    index = vector_index.build(path, frame(spark, vectors | odd))
    assert index.rows.count() == 1500 and 1 <= index.quantiser.probes < len(index.quantiser.centres)
    queries = {q: vectors[q] + 0.1 for q in range(0, 1500, 30)}
    got, want = found(index.search(asked(spark, queries), 10)), exact(vectors, queries, 10)
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.93
    keep = lambda i: i % 300 == 7
    got, want = found(index.search(asked(spark, queries), 5, F.col("id") % 300 == 7)), exact(vectors, queries, 5, keep)
    assert all(len(got[q]) == 5 and all(keep(i) for i in got[q]) for q in want)
    assert found(index.exhaustive().search(asked(spark, queries), 5, F.col("label") == 1)) == exact(vectors, queries, 5, lambda i: i % 3 == 1)
    changed = {i: v for i, v in vectors.items() if i % 10} | {3: -vectors[3], 9000: vectors[8]}
    codes = {r.id: (r.list, bytes(r.code)) for r in index.rows.collect()}
    after = vector_index.update(path, frame(spark, changed, {4: 77}))
    rows = {r.id: r for r in after.rows.collect()}
    assert set(rows) == set(changed) and rows[4].label == 77 and all((r.list, bytes(r.code)) == codes[i] for i, r in rows.items() if i not in (3, 9000))
    assert found(after.exhaustive().search(asked(spark, queries), 10)) == exact(changed, queries, 10)


def test_few_equal_and_no_rows(spark, path):
    index = vector_index.build(path, frame(spark, {}))
    assert index.search(asked(spark, {1: [1.0]}), 3).count() == 0
    same = {i: [1.0, 0.0, 0.0] for i in range(6)} | {6: [0.0, 0.0, 0.0]}
    index = vector_index.update(path, frame(spark, same))
    assert found(index.search(asked(spark, {1: [2.0, 0.0, 0.0], 2: [1.0]}), 10)) == {1: [0, 1, 2, 3, 4, 5, 6]}
    assert found(index.search(asked(spark, {1: [2.0, 0.0, 0.0]}), 3, exclude_self=True)) == {1: [0, 2, 3]}

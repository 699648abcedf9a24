"""Searches for weights against fixed sets, known optima and a plain ranking."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell.operators import evaluation, retrieval, weights


def bowl(at):
    return lambda sets: -((np.asarray(sets) - at) ** 2).sum(axis=1)


@pytest.mark.parametrize("search", [weights.evolve, weights.descend])
def test_finds_the_top_of_a_bowl(search):
    at, bounds = np.array([0.3, 1.7, -0.4]), np.array([[0, 1], [0, 3], [-1, 1]])
    steps = {"generations": 60, "patience": 60} if search is weights.evolve else {"steps": 120}
    best, value, asked = search(bowl(at), bounds, np.array([[0.9, 0.1, 0.9]]), **steps)
    assert np.abs(best - at).max() < 0.02 and value == bowl(at)([best])[0] and asked > 20
    again = search(bowl(at), bounds, np.array([[0.9, 0.1, 0.9]]), **steps)
    assert (again[0] == best).all() and again[1:] == (value, asked)


def test_stays_within_bounds_and_asks_whole_generations():
    seen = []

    def measure(sets):
        seen.append(np.array(sets))
        return np.asarray(sets).sum(axis=1)

    best, value, asked = weights.evolve(measure, np.array([[0, 0.5], [0, 3]]), np.array([[0.5, 3.0]]), sets=8, generations=5)
    assert value == 3.5 and all((s >= 0).all() and (s <= [0.5, 3]).all() and len(s) == 8 for s in seen) and asked == 8 * len(seen)


@pytest.fixture(scope="module")
def pools(spark):
    """Eighty queries whose expected row has an overlap, and more recent rows that are not expected."""
    draw = random.Random(7)
    names = ["normalised" if k == "rrf" else k for k in retrieval.WEIGHTS] + list(retrieval.ADDED)
    rows = []
    for q in range(80):
        for i in range(12):
            value = {n: draw.random() if n in ("normalised", "recency", "depth") else 0.0 for n in names}
            value["overlap"] = (0.5 if i == 3 else 0.2) + draw.random() * 0.2
            value["superseded_penalty"] = -0.2 if draw.random() < 0.3 else 0.0
            rows.append((q, i, *(value[n] for n in names)))
    signals = spark.createDataFrame(rows, "query_id long, id long, " + ", ".join(f"{n} double" for n in names))
    expected = spark.createDataFrame([(q, 3) for q in range(80)] + [(q, 3) for q in range(9)] + [(99, 3)], "query_id long, id long")
    return signals, expected, names, rows


def plain(pools, weight, factor):
    """Mean reciprocal rank by a plain ranking; the query without a pool counts as zero."""
    _, _, names, rows = pools
    total = 0.0
    for q in range(80):
        scores = []
        for r in rows[q * 12 : q * 12 + 12]:
            v = dict(zip(names, r[2:], strict=True))
            s = sum(v["normalised" if k == "rrf" else k] * w for k, w in weight.items()) + sum(v[k] * f for k, f in factor.items())
            scores.append((-round(s, 6), r[1]))
        total += 1 / (sorted(scores).index(next(s for s in scores if s[1] == 3)) + 1)
    return total / 81


@pytest.mark.parametrize("method", list(weights.METHODS))
def test_no_fixed_set_is_better(spark, pools, method):
    signals, expected, _, _ = pools
    sets = [("a", 0.45, 0.2), ("b", 0.1, 0.5), ("c", 0.5, 0.01)]
    start = [{"rrf": a, "overlap": b} for _, a, b in sets]
    limits = {"sets": 10, "generations": 4} if method == "differential_evolution" else {"steps": 8}
    got = weights.optimise(signals, expected, start, method, **limits).collect()
    one = got[0]
    best = {(r.kind, r.name): r.after for r in got}
    w, f = ({n: v for (kind, n), v in best.items() if kind == k} for k in ("weight", "factor"))
    assert one.mrr_after == pytest.approx(plain(pools, w, f), abs=2e-6) and one.mrr_before == pytest.approx(plain(pools, retrieval.WEIGHTS, {k: 1.0 for k in retrieval.ADDED}), abs=2e-6)
    assert one.mrr_after > one.mrr_before
    if method == "differential_evolution":
        table = spark.createDataFrame(sets, "name string, w_rrf double, w_overlap double")
        fixed = evaluation.search(signals, table, expected.distinct(), retrieval.score({"rrf": F.col("w_rrf"), "overlap": F.col("w_overlap")})).collect()
        assert len(fixed) == 3 and all(one.mrr_after >= r.mrr for r in fixed)
        assert weights.optimise(signals, expected, start, method, **limits).collect() == got


def test_nothing_expected_keeps_the_weights(pools):
    signals, expected, _, _ = pools
    got = weights.optimise(signals, expected.where("false"), sets=4, generations=1).collect()
    assert all(r.before == r.after and r.mrr_after == 0 for r in got)


def test_queries_of_weights_part_no_text_into_words(spark, monkeypatch):
    from lorewell.operators import retrieval
    from lorewell.plans import catalog, retrieval_queries

    sf = "/root/testdata/sf0.001"
    retrieval_queries._index(spark, sf)
    parted, plain = [], retrieval.tokens
    monkeypatch.setattr(retrieval, "tokens", lambda c: parted.append(str(c)) or plain(c))
    for name in ("weight_search", "weight_sweep"):
        assert catalog.queries()[name](spark, sf).count() in (4, 5)
    read = spark.read.parquet(f"{sf}/documents.parquet")
    assert parted and read.count() and all(c == str(F.col("text")) for c in parted)
    found = {(r.query_id, r.id) for r in retrieval_queries._expected(spark, sf).collect()}
    texts = {r.doc_id: r.text or "" for r in read.collect()}
    asked = {r.query_id: r.text for r in retrieval_queries._queries(spark, sf).collect()}
    assert found == {(q, i) for q, p in asked.items() for i, t in texts.items() if p in t} and found
    assert not any("explode" in str(x).lower() for x in [retrieval_queries._expected(spark, sf)._jdf.queryExecution().optimizedPlan()])

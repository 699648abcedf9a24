"""Whitening against numpy's eigenvectors and Python's whole numbers."""

import math

import numpy as np
import pytest

from lorewell.llm import catalog, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, row string, n string, component string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "a", "b", "c", "d") for i, v in vectors], SCHEMA)


def check(rows, vectors, components=16):
    usable = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted(set(tuple(x) for _, x in usable))
    n, sums = len(fit), [sum(col) for col in zip(*fit, strict=True)]
    centred = np.array([[n * a - s for a, s in zip(x, sums, strict=True)] for x in fit], float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    count = min(components, int((values > 1e-13 * values[0]).sum()))
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, []).append(r)
    assert sum(len(x) for x in got.values()) == len(usable) * count
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error <= 1e-9 and {r.n for r in rows} == {n}
    signs = {}
    for i, x in usable:
        offset = [n * a - s for a, s in zip(x, sums, strict=True)]
        own = sorted((r for r in got[i] if r.deviation == sum(o * o for o in offset)), key=lambda r: r.component)
        assert {r.component for r in own} == set(range(1, count + 1))
        for r in own:
            k = r.component - 1
            want = float(np.array(offset, float) / n @ axes[:, k]) / math.sqrt(values[k])
            assert abs(r.whitened) == pytest.approx(abs(want), abs=1e-6)
            assert r.explained == pytest.approx(values[k] / values.sum(), rel=1e-9)
            if abs(want) > 1e-3:
                assert signs.setdefault(k, r.whitened * want > 0) == (r.whitened * want > 0)


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((300, 20)) * np.linspace(1, 4, 20))]
    vectors += [(900 + i, vectors[0][1]) for i in range(200)]
    vectors += [(5000, None), (5001, [None] * 20), (5002, [float("nan")] + [0.0] * 19), (5003, [float("inf")] * 20), (5004, [])]
    check(whitening.whitened(frame(spark, vectors)).collect(), vectors)


def test_given_rows(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()
    check(catalog.queries()["op12_embedding_whitening"](spark, "/root/testdata/sf0.001").collect(), [(r.vec_id, r.embedding) for r in rows])


def test_few_dimensions_and_no_spread(spark):
    flat = [(i, [float(i), 2.0 * i, 1.0]) for i in range(20)]
    check(whitening.whitened(frame(spark, flat)).collect(), flat)
    assert whitening.whitened(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    empty = whitening.whitened(frame(spark, []))
    assert empty.collect() == [] and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_lengths_are_fitted_apart(spark):
    short, long = [(i, [float(i % 7), float(i % 5)]) for i in range(35)], [(100 + i, [float(i % 7), float(i % 3), float(i)]) for i in range(30)]
    rows = whitening.whitened(frame(spark, short + long + [(200, [9.0])])).collect()
    check([r for r in rows if r.vec_id < 100], short)
    check([r for r in rows if 100 <= r.vec_id < 200], long)


def test_huge_entries(spark):
    vectors = [(i, [float(i % 9) * 1e30, float(i % 4) - 1e20 * (i % 2)]) for i in range(40)]
    rows = whitening.whitened(frame(spark, vectors)).collect()
    assert {r.deviation for r in rows} == {None} and rows[0].identity_error <= 1e-9
    exact = whitening.squares(whitening.offsets(np.array([[2**53, 1], [-5, 7]]), 1 << 40, [3, 2**90]))
    assert exact == [((2**93 - 3) ** 2 + (2**40 - 2**90) ** 2), ((-5 * 2**40 - 3) ** 2 + (7 * 2**40 - 2**90) ** 2)]

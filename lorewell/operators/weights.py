"""Weights of a ranking that find what is expected: searches without derivatives, every step of which is one plan."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut, drop_table
from . import evaluation, retrieval

#: Least and greatest weight of a signal, factor of an addition, and factors of additions that differ.
WEIGHT, FACTOR = (0.01, 0.5), (0.0, 3.0)
OTHER = {"reinforcement": (0.0, 0.1 / retrieval.REINFORCEMENT)}
#: Sets in a generation, generations at most, and generations without a gain after which the search ends.
SETS, GENERATIONS, PATIENCE = 16, 24, 6

Measure = Callable[[np.ndarray], np.ndarray]


def evolve(measure: Measure, bounds: np.ndarray, start: np.ndarray, sets: int = SETS, generations: int = GENERATIONS, patience: int = PATIENCE, seed: int = 42) -> tuple[np.ndarray, float, int]:
    """(best, its value, sets measured) by differential evolution, the greatest value being best.

    `measure` takes a whole generation, a set a row. The first holds the rows of `start`, so nothing that was given is
    better than the result; the others are drawn within `bounds` (least, greatest), one in each slice of every
    dimension. A trial is the best set and a multiple of the difference of two others, crossed with its parent, and
    replaces it unless it is worse; a value beyond the bounds is drawn anew. The same seed gives the same search.
    """
    draw = np.random.default_rng(seed)
    low, high = np.asarray(bounds, dtype=float).T
    sets, d = max(sets, 4), len(low)
    slices = (np.argsort(draw.random((sets, d)), axis=0) + draw.random((sets, d))) / sets
    now = np.vstack([np.clip(np.asarray(start, dtype=float).reshape(-1, d), low, high), low + slices * (high - low)])[: max(sets, len(start))]
    values = np.asarray(measure(now))
    asked, idle = len(now), 0
    for _ in range(generations):
        if idle >= patience or d == 0:
            break
        best = values.max()
        others = np.array([draw.permutation(np.delete(np.arange(len(now)), i))[:2] for i in range(len(now))])
        trial = now[values.argmax()] + draw.uniform(0.5, 1.0) * (now[others[:, 0]] - now[others[:, 1]])
        crossed = draw.random(now.shape) < 0.7
        crossed[np.arange(len(now)), draw.integers(d, size=len(now))] = True
        trial = np.where(crossed, trial, now)
        trial = np.where((trial < low) | (trial > high), draw.uniform(low, high, now.shape), trial)
        got = np.asarray(measure(trial))
        asked += len(trial)
        kept = got >= values
        now, values = np.where(kept[:, None], trial, now), np.where(kept, got, values)
        idle = 0 if values.max() > best else idle + 1
    return now[values.argmax()], float(values.max()), asked


def descend(measure: Measure, bounds: np.ndarray, start: np.ndarray, steps: int = GENERATIONS, near: float = 0.005) -> tuple[np.ndarray, float, int]:
    """(best, its value, sets measured) by the simplex method of Nelder and Mead from the first row of `start`.

    The points that a step may need (reflected, expanded, contracted on either side) are measured together, so a step
    is one plan, or two if the simplex shrinks; it ends when no corner is farther than `near` from the best.
    """
    low, high = np.asarray(bounds, dtype=float).T
    first = np.clip(np.asarray(start, dtype=float).reshape(-1, len(low))[0], low, high)
    reach = np.diag(np.where(first + 0.2 * (high - low) <= high, 0.2, -0.2) * (high - low))
    simplex = np.vstack([first, first + reach])
    values = np.asarray(measure(simplex))
    asked = len(simplex)
    for _ in range(steps):
        order = np.argsort(-values, kind="stable")
        simplex, values = simplex[order], values[order]
        if np.abs(simplex - simplex[0]).max() <= near:
            break
        middle = simplex[:-1].mean(axis=0)
        points = np.clip(middle + np.array([[1.0], [2.0], [0.5], [-0.5]]) * (middle - simplex[-1]), low, high)
        reflected, expanded, outside, inside = got = np.asarray(measure(points))
        asked += 4
        if reflected > values[0]:
            take = 1 if expanded > reflected else 0
        elif reflected > values[-2]:
            take = 0
        elif reflected > values[-1]:
            take = 2 if outside >= reflected else None
        else:
            take = 3 if inside > values[-1] else None
        if take is not None:
            simplex[-1], values[-1] = points[take], got[take]
        else:
            simplex[1:] = simplex[0] + (simplex[1:] - simplex[0]) / 2
            values[1:] = measure(simplex[1:])
            asked += len(simplex) - 1
    return simplex[values.argmax()], float(values.max()), asked


METHODS = {"differential_evolution": evolve, "nelder_mead": descend}


def optimise(signals: DataFrame, expected: DataFrame, start: list[dict[str, float]] | None = None, method: str = "differential_evolution", **search) -> DataFrame:
    """name, kind (weight or factor), before, after, mrr_before, mrr_after, measured: what finds the expected rows best.

    signals: retrieval.signals of the queries' pools; expected: (query_id, id). The search begins at the library's own
    weights and, if by evolution, at `start` too, sets of some weights. Weights have four decimals. Pools are written once and dealt out by query, so that each step
    scores them under all of its sets where they are; only a set's mean reciprocal rank comes to the driver. A query
    whose expected row is not in its pool counts as zero; without expected rows the own weights stay.
    """
    spark = signals.sparkSession
    names = [("weight", k) for k in retrieval.WEIGHTS] + [("factor", k) for k in retrieval.ADDED]
    own = [retrieval.WEIGHTS.get(k, 1.0) for _, k in names]
    begin = np.array([own, *([s.get(k, o) for (_, k), o in zip(names, own, strict=True)] for s in start or [])])
    bounds = np.array([WEIGHT if kind == "weight" else OTHER.get(k, FACTOR) for kind, k in names])
    scored = ["normalised" if k == "rrf" else k for _, k in names]
    wanted = cut(expected.select("query_id", "id").distinct(), "expected")
    pools = cut(signals.join(wanted.select("query_id").distinct(), "query_id", "left_semi").select("query_id", "id", *scored), "pools")
    columns = {key: F.col(f"{key[0]}_{key[1]}") for key in names}
    score = retrieval.score({k: c for (kind, k), c in columns.items() if kind == "weight"}, {k: c for (kind, k), c in columns.items() if kind == "factor"})

    def measure(sets: np.ndarray) -> np.ndarray:
        rows = [(i, *map(float, s)) for i, s in enumerate(sets.round(4))]
        table = spark.createDataFrame(rows, "name int, " + ", ".join(f"{kind}_{k} double" for kind, k in names))
        found = {r["name"]: r["mrr"] for r in evaluation.search(pools.repartition("query_id"), table, wanted, score).collect()}
        return np.array([found.get(i, 0.0) for i in range(len(rows))])

    before = float(measure(begin[:1])[0])
    best, after, asked = METHODS[method](measure, bounds, begin, **search)
    drop_table(pools)
    drop_table(wanted)
    if after <= before:
        best, after = np.array(own), before
    return spark.createDataFrame([(k, kind, float(a), round(float(b), 4), before, after, asked) for (kind, k), a, b in zip(names, own, best, strict=True)], "name string, kind string, before double, after double, mrr_before double, mrr_after double, measured int")

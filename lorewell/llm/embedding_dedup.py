"""Near-duplicate vectors of one label, found through an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import cut
from .vectors import finite, nonzero

COSINE, RECALL = 0.98, 0.9999
#: The codebooks are learned from at most so many different vectors, 16 for each centroid; every vector is indexed.
SAMPLE = 1 << 17
#: Vectors aimed at for a cell, and the most centroids of a half, so that cells keep that size up to 4e10 vectors.
CELL, CODES = 640, 1 << 13
#: Rows of a side that meet in one task at a time.
BLOCK = 256


def codebook(points: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means centroids of the points."""
    rng = np.random.default_rng(seed)
    centers = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        at = distances(points, centers).argmin(1)
        sums, counts = np.zeros_like(centers), np.bincount(at, minlength=len(centers))
        np.add.at(sums, at, points)
        centers[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centers


def distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each centre."""
    return np.maximum((points**2).sum(1)[:, None] + (centers**2).sum(1)[None, :] - 2 * points @ centers.T, 0)


def traverse(first: np.ndarray, second: np.ndarray, reach: float) -> Iterator[int]:
    """Cells in the order of the sum of both halves' squared distances, up to `reach` above the nearest (multi-sequence).

    A heap holds the frontier of pairs of ranks; the pair after a visited one is pushed when its neighbours with
    smaller ranks have been visited.
    """
    a, b = first.argsort(kind="stable"), second.argsort(kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    limit, heap, seen = x[0] + y[0] + reach, [(x[0] + y[0], 0, 0)], set()
    while heap and heap[0][0] <= limit:
        _, i, j = heapq.heappop(heap)
        yield int(a[i]) * len(y) + int(b[j])
        seen.add((i, j))
        if i + 1 < len(x) and (j == 0 or (i + 1, j - 1) in seen):
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
        if j + 1 < len(y) and (i == 0 or (i - 1, j + 1) in seen):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))


def units(vectors) -> np.ndarray:
    rows = np.array([np.asarray(v, np.float64) for v in vectors]).reshape(len(vectors), -1)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows**2).sum(1, keepdims=True))


def codes(rows: int) -> int:
    """Centroids of a half for so many vectors."""
    return int(np.clip(round((rows / CELL) ** 0.5), 1, CODES))


class MultiIndex:
    """Codebooks for both halves of unit vectors and the reach that finds links with the target recall.

    The reach is measured on the sample: each vector is turned by exactly the angle of the threshold in a seeded
    random direction, the hardest link there is, and the reach is the recall quantile of how far beyond the
    nearest cell the turned vector's cell comes in the traversal.
    """

    def __init__(self, sample: np.ndarray, rows: int, cosine: float, recall: float, seed: int = 5) -> None:
        self.half = sample.shape[1] // 2
        k = min(codes(rows), len(sample))
        self.books = [codebook(part, k, seed + i) for i, part in enumerate(self.halves(sample))]
        noise = np.random.default_rng(seed).standard_normal(sample.shape)
        noise -= (noise * sample).sum(1, keepdims=True) * sample
        length = np.sqrt((noise**2).sum(1, keepdims=True))
        turned = cosine * sample + (1 - cosine**2) ** 0.5 * noise / np.where(length > 0, length, 1)
        own, other = self.gaps(sample), self.gaps(turned)
        beyond = sum(d[np.arange(len(d)), e.argmin(1)] - d.min(1) for d, e in zip(own, other, strict=True))
        self.reach = float(np.quantile(beyond, recall, method="higher")) + 1e-9

    def halves(self, rows: np.ndarray) -> list[np.ndarray]:
        return [rows[:, : self.half], rows[:, self.half :]]

    def gaps(self, rows: np.ndarray) -> list[np.ndarray]:
        return [distances(part, book) for part, book in zip(self.halves(rows), self.books, strict=True)]

    def cells(self, rows: np.ndarray) -> list[list[int]]:
        """The cells each row visits; the first is its own. Of two linked rows the one with the smaller cell finds the other,
        so those before its own are left out: the reach holds the recall for either side alone."""
        first, second = self.gaps(rows)
        found = [list(traverse(a, b, self.reach)) for a, b in zip(first, second, strict=True)]
        return [[own, *(c for c in rest if c > own)] for own, *rest in found]


def _meet(cosine: float):
    def meet(group: pd.DataFrame) -> pd.DataFrame:
        """node, root, found: links between this block's probes and its indexed vectors, each pair once."""
        probes, indexed = group[group["probing"]], group[~group["probing"]]
        none = pd.DataFrame({"node": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64"), "found": pd.Series(dtype="int64")})
        if not len(probes) or not len(indexed):
            return none
        near = units(probes["embedding"].tolist()) @ units(indexed["embedding"].tolist()).T >= cosine
        p, q = probes["rep"].to_numpy(), indexed["rep"].to_numpy()
        # of two in the same cell the one with the smaller rep is the probe
        near &= ~probes["home"].to_numpy()[:, None] | (p[:, None] < q[None, :])
        if not near.any():
            return none
        found = np.concatenate([near @ indexed["copies"].to_numpy(), near.T @ probes["copies"].to_numpy()])
        roots_p, roots_q, top = p.copy(), q.copy(), np.iinfo(np.int64).max
        while True:
            to_p = np.minimum(roots_p, np.where(near, roots_q[None, :], top).min(1))
            to_q = np.minimum(roots_q, np.where(near, to_p[:, None], top).min(0))
            if (to_p == roots_p).all() and (to_q == roots_q).all():
                break
            roots_p, roots_q = to_p, to_q
        out = pd.DataFrame({"node": np.concatenate([p, q]), "root": np.concatenate([roots_p, roots_q]), "found": found})
        return out[(out["found"] > 0) | (out["node"] != out["root"])]

    return meet


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Rows link if their labels are equal and not null and their cosine, in double precision, is at least `cosine`.
    A vector that is null, empty or zero, or holds a null or a component that isn't finite, links with nothing, nor
    do vectors of different lengths with each other. Equal vectors of a label are compared once and counted as
    often as they occur; rows that repeat a vec_id are other vectors to each other. component_id is the smallest
    vec_id that links lead to. An empty table gives no rows; further columns are ignored.

    Vectors and the cells they visit meet in a grid of blocks of about BLOCK rows a side, so a cell with very many
    vectors is many tasks. A block hands on, for each vector, how many links it found and one link towards its
    block's components, not the pairs.
    """
    rows = embeddings.select("vec_id", "label", "embedding")
    good = F.col("label").isNotNull() & finite(F.col("embedding")) & nonzero(F.col("embedding"))
    rows = rows.withColumn("usable", F.coalesce(good, F.lit(False)))
    different = cut(rows.where("usable").groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("rep")), "vectors")
    sizes = {r["d"]: r["n"] for r in different.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect()}
    links = None
    for size, n in sorted(sizes.items()):
        part = _blocks(different.where(F.size("embedding") == size), n, cosine, recall)
        links = part if links is None else links.unionByName(part)
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = cut(links, "links")
    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("node").agg(F.sum("found").alias("found"))
    known = different.join(counts, different.rep == counts.node, "left").drop("node").join(roots, F.col("rep") == roots.node, "left")
    known = cut(known.select("label", "embedding", (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")), "classes")
    linked = rows.where("usable").join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _blocks(vectors: DataFrame, n: int, cosine: float, recall: float) -> DataFrame:
    """Links of vectors of one length, block by block."""
    most = min(SAMPLE, max(1 << 14, 16 * codes(n)))
    sample = vectors.select("embedding").orderBy(F.xxhash64("rep"), "rep").limit(most).toPandas()
    index = MultiIndex(units(sample["embedding"].tolist()), n, cosine, recall)

    @F.pandas_udf("array<int>")
    def visit(batch: pd.Series) -> pd.Series:
        return pd.Series(index.cells(units(batch.tolist()))) if len(batch) else pd.Series([], dtype=object)

    seen = cut(vectors.select("label", "rep", "copies", "embedding", visit("embedding").alias("cells")), "cells")
    where = ["label", "cell"]
    homes = seen.select("label", F.col("cells")[0].alias("cell"), "rep", "copies", "embedding", F.lit(True).alias("home"))
    visits = seen.select("label", F.posexplode("cells").alias("place", "cell"), "rep", "copies", "embedding").withColumn("home", F.col("place") == 0).drop("place")
    blocks = lambda df, name: df.groupBy(where).agg(F.ceil(F.count("*") / BLOCK).alias(name))
    grid = cut(blocks(homes, "homes").join(blocks(visits, "visits"), where), "grid")
    spread = F.pmod(F.xxhash64("rep"), F.lit(1 << 30))
    placed = lambda df, own, other, probing: (
        df.join(grid, where)
        .withColumn(own + "_at", (spread % F.col(own)).cast("int"))
        .withColumn(other + "_at", F.explode(F.sequence(F.lit(0), (F.col(other) - 1).cast("int"))))
        .select("label", "cell", "homes_at", "visits_at", "rep", "copies", "embedding", "home", F.lit(probing).alias("probing"))
    )
    both = placed(homes, "homes", "visits", False).unionByName(placed(visits, "visits", "homes", True))
    return both.groupBy("label", "cell", "homes_at", "visits_at").applyInPandas(_meet(cosine), "node long, root long, found long")


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x AS vec_id, MIN(y) AS component_id FROM reach GROUP BY x)
SELECT vec_id, (SELECT COUNT(*) FROM links WHERE x = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM least
"""

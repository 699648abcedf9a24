"""Cosine search of a stated set of queries against all rows, cosines within a key, and greedy clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries that are sent to every task at once; more are searched in further blocks.
BLOCK = 1024
#: Vectors of a key from either side that meet in one group, about; rows of cosines that are held at once; and how near to a
#: threshold a cosine is added up again in the order of its components.
SIDE, STRIP, NEAR = 4096, 256, 1e-9


def cosine(a: str, b: str) -> Column:
    """Cosine of two array columns in double precision; 0 if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def unit_rows(vectors) -> np.ndarray:
    rows = np.array([np.asarray(v, np.float64) for v in vectors])
    norms = np.sqrt((rows**2).sum(1, keepdims=True))
    return rows / np.where(norms > 0, norms, 1)


def top_k(queries: DataFrame, rows: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """query_id, id, similarity, rank: the k rows of greatest cosine for each query, ties to the smaller id.

    queries: (query_id, embedding); rows: (id, embedding). Each task keeps its own k best of every query before the
    shuffle. Queries go out in blocks of BLOCK, of which there are as many as the queries need.
    """
    numbered = queries.where("embedding IS NOT NULL").select("query_id", "embedding")
    blocks = -(-numbered.count() // BLOCK)
    found = None
    for n in range(max(1, blocks)):
        own = numbered.where(F.pmod(F.xxhash64("query_id"), F.lit(max(1, blocks))) == n).toPandas()
        part = rows.where("embedding IS NOT NULL").select("id", "embedding").mapInPandas(_searcher(own, k, exclude_self), "query_id long, id long, similarity double")
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _searcher(queries: pd.DataFrame, k: int, exclude_self: bool):
    ids = queries["query_id"].to_numpy(np.int64)
    wanted = unit_rows(queries["embedding"]) if len(queries) else np.zeros((0, 0))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch) or not len(ids):
                continue
            scores, own = wanted @ unit_rows(batch["embedding"]).T, batch["id"].to_numpy(np.int64)
            if exclude_self:
                scores[ids[:, None] == own[None, :]] = -np.inf
            order = np.lexsort((np.broadcast_to(own, scores.shape), -scores), axis=1)[:, :k]
            out = pd.DataFrame({"query_id": np.repeat(ids, order.shape[1]), "id": own[order].ravel(), "similarity": np.take_along_axis(scores, order, 1).ravel()})
            yield out[np.isfinite(out["similarity"])]

    return search


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors as rows, filled up with zeros; their lengths): one that is null or holds null is all zeros, of length -1."""
    array = column.combine_chunks()
    lengths = array.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = array.flatten()
    owner = np.repeat(np.arange(len(lengths)), np.maximum(lengths, 0))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0), np.maximum(lengths, 0))
    rows = np.zeros((len(lengths), max(1, lengths.max(initial=1))))
    rows[owner, place] = flat.to_numpy(zero_copy_only=False)
    if flat.null_count:
        gone = np.unique(owner[flat.is_null().to_numpy(zero_copy_only=False)])
        rows[gone], lengths[gone] = 0, -1
    return rows, lengths


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.cumsum(a * b, axis=1)[:, -1]


def _strips(left: pa.Table, right: pa.Table, threshold: float | None) -> Iterator[tuple[slice, np.ndarray]]:
    """The cosines of `cosine` between all rows of both, STRIP rows of the left at a time."""
    (a, of_a), (b, of_b) = _matrix(left["_a"]), _matrix(right["_b"])
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    with np.errstate(all="ignore"):
        own, theirs = _in_order(a, a), _in_order(b, b)
        for at in range(0, len(a), STRIP):
            rows = slice(at, at + STRIP)
            norm = np.sqrt(own[rows, None] * theirs)
            found = np.where(norm <= 0, 0.0, a[rows] @ b.T / norm)
            if threshold is not None:
                i, j = np.nonzero((np.abs(found - threshold) < NEAR) & (norm > 0))
                for n in range(0, len(i), 65_536):
                    x, y = i[n : n + 65_536], j[n : n + 65_536]
                    found[x, y] = _in_order(a[rows][x], b[y]) / norm[x, y]
            found[of_a[rows, None] != of_b] = 0.0
            yield rows, found


def met_in_key(candidates: DataFrame, stored: DataFrame, key: str, threshold: float | None = None) -> DataFrame:
    """candidate_id, similarity, twin of candidates (candidate_id, key, embedding): the greatest cosine with a stored row of
    their key, null without one; and, with a threshold, whether one with an earlier candidate reaches it.

    Both sides of a key are dealt out in blocks of about SIDE vectors and every two blocks are one group, so that a task holds
    two blocks and a strip of their cosines, however many rows a key has. Equal vectors are looked at once.
    """
    kind = dict(candidates.dtypes)["candidate_id"]
    own = candidates.where("candidate_id IS NOT NULL").select(F.col(key).alias("_key"), "candidate_id", "embedding")
    others = stored.where("embedding IS NOT NULL").select(F.col(key).alias("_key"), F.lit(None).cast(kind).alias("_earlier"), "embedding").dropDuplicates(["_key", "embedding"])
    if threshold is not None:
        others = others.unionByName(own.groupBy("_key", "embedding").agg(F.min("candidate_id").alias("_earlier")))
    blocks = lambda rows, name: rows.groupBy("_key").agg(F.ceil(F.count("*") / SIDE).cast("int").alias(name))
    dealt = blocks(own, "_m").join(blocks(others, "_n"), "_key")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one_of = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    left = own.join(dealt, "_key").select("_key", one_of("candidate_id", "_m").alias("_i"), each("_n").alias("_j"), "candidate_id", F.col("embedding").alias("_a"))
    right = others.join(dealt, "_key").select("_key", each("_m").alias("_i"), one_of("embedding", "_n").alias("_j"), "_earlier", F.col("embedding").alias("_b"))
    schema = T.StructType([candidates.schema["candidate_id"], T.StructField("similarity", T.DoubleType()), T.StructField("twin", T.BooleanType())])

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, greatest, twin = a["candidate_id"], [], []
        if len(a) and len(b):
            kept = b["_earlier"].is_null().to_numpy()
            of = np.asarray(ids.to_pylist())
            earlier = np.asarray(b["_earlier"].filter(pa.array(~kept)).to_pylist(), dtype=of.dtype if kept.all() else None)
            for rows, found in _strips(a, b, threshold):
                greatest += found[:, kept].max(axis=1).tolist() if kept.any() else [None] * len(found)
                twin += ((earlier < of[rows, None]) & ~(found[:, ~kept] < threshold)).any(axis=1).tolist() if len(earlier) else [False] * len(found)
        return pa.table({"candidate_id": ids if greatest else ids.slice(0, 0), "similarity": pa.array(greatest, pa.float64()), "twin": pa.array(twin, pa.bool_())})

    met = left.groupBy("_key", "_i", "_j").cogroup(right.groupBy("_key", "_i", "_j")).applyInArrow(meet, schema)
    return met.groupBy("candidate_id").agg(F.max("similarity").alias("similarity"), F.bool_or("twin").alias("twin"))


def greedy_clusters(rows: DataFrame, key: str, threshold: float = 0.86) -> DataFrame:
    """key, id, cluster: rows in the order of (position, id) join the nearest seed at the threshold or become one.

    Clusters of two or more are numbered by first appearance; others have no number. The order decides, so the rows
    of a key are one task's work; a window of them is meant, as the key (a channel and a day, say), not a corpus.
    """

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["position", "id"])
        vectors = unit_rows(group["embedding"])
        seeds, labels = [], []
        for v in vectors:
            near = vectors[seeds] @ v if seeds else np.zeros(0)
            if len(near) and near.max() >= threshold:
                labels.append(int(near.argmax()))
            else:
                labels.append(len(seeds))
                seeds.append(len(labels) - 1)
        counts = pd.Series(labels).value_counts()
        numbers = {label: n for n, label in enumerate(dict.fromkeys(x for x in labels if counts[x] > 1))}
        return pd.DataFrame({key: group[key], "id": group["id"], "cluster": pd.Series([numbers.get(x) for x in labels], index=group.index, dtype="Int64")})

    kind = dict(rows.dtypes)[key]
    return rows.select(key, "id", "position", "embedding").groupBy(key).applyInPandas(cluster, f"{key} {kind}, id long, cluster long")

"""Exact top-k by inner product: norm buckets, each pruned by length or by coordinates, then verified."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut
from .vectors import finite

K, SCALE, EVERY = 5, 256.0, 50
#: Vectors and queries that meet in one task at a time.
VECTORS, QUERIES = 2048, 256
#: A bucket holds lengths within this factor of each other.
WIDTH = 1.05
#: Local cosine threshold from which coordinates prune, else lengths do.
COORDINATES = 0.6
#: Longest vectors that set the first thresholds.
SEEDS = 2048


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of integral rows, as longs; beyond a long's range they end at its bounds."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in a], dtype=object) @ np.array([[int(x) for x in row] for row in b], dtype=object).T
    return np.array([[max(-(2**63), min(2**63 - 1, v)) for v in row] for row in exact], dtype=np.int64).reshape(len(a), len(b))


def feasible(units: np.ndarray, query: np.ndarray, threshold: float, focus: int = 4) -> np.ndarray:
    """Rows of unit vectors whose cosine with the unit query can reach the threshold, by the query's largest coordinates.

    If the cosine is at least t, then coordinate f of the row lies in q_f t -+ sqrt((1 - t^2)(1 - q_f^2)), or
    outside of it only where the row is nearer to the query's axis still.
    """
    ok, angle = np.ones(len(units), bool), np.arccos(np.clip(threshold, -1, 1))
    for f in np.argsort(-np.abs(query))[:focus]:
        to_axis = np.arccos(np.clip(query[f], -1, 1))
        low, high = np.cos(min(np.pi, to_axis + angle)), np.cos(max(0.0, to_axis - angle))
        ok &= (units[:, f] >= low - 1e-9) & (units[:, f] <= high + 1e-9)
    return ok


def search_block(queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score): for each query its k best of the block, without rows that cannot reach its floor."""
    lengths, sizes = np.sqrt((vectors**2).sum(1)), np.sqrt((queries**2).sum(1))
    order = np.argsort(-lengths, kind="stable")
    vectors, ids, lengths = vectors[order], ids[order], lengths[order]
    units, axes = vectors / np.where(lengths > 0, lengths, 1)[:, None], queries / np.where(sizes > 0, sizes, 1)[:, None]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    whole: list[int] = []
    slack = 1e-9 * (1 + np.abs(floors)) + 1e-6
    for n, (size, floor) in enumerate(zip(sizes, floors - slack, strict=True)):
        best = size * lengths[0] if len(lengths) else 0.0
        if best < floor:
            continue
        local = floor / best if best > 0 else -1.0
        if local >= COORDINATES:
            rows = np.flatnonzero(feasible(units, axes[n], local))
        elif floor > 0:
            rows = np.arange(int(np.searchsorted(-lengths * size, -floor, side="right")))
        else:
            rows = None
        if rows is None or 2 * len(rows) > len(vectors):
            whole.append(n)
        elif len(rows):
            out.append(_best(products(queries[n : n + 1], vectors[rows]), query_ids[n : n + 1], floors[n : n + 1], ids[rows], k))
    if whole:
        out.append(_best(products(queries[whole], vectors), query_ids[whole], floors[whole], ids, k))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _best(scores: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k best of each row by score and smaller id; the query's own row is no candidate."""
    queries, found, best = [], [], []
    for own, floor, row in zip(query_ids, floors, scores, strict=True):
        keep = np.flatnonzero((ids != own) & (row >= floor))
        if len(keep) > k:
            kth = np.partition(row[keep], len(keep) - k)[len(keep) - k]
            keep = keep[row[keep] >= kth]
        keep = keep[np.lexsort((ids[keep], -row[keep]))][:k]
        queries.append(np.full(len(keep), own))
        found.append(ids[keep])
        best.append(row[keep])
    return np.concatenate(queries), np.concatenate(found), np.concatenate(best)


def packed(vectors: np.ndarray) -> bytes:
    """Integral rows in the narrowest type that holds them."""
    most = np.abs(vectors).max(initial=0)
    return vectors.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64).tobytes()


def unpacked(data: bytes, rows: int, size: int) -> np.ndarray:
    if not rows or not size:
        return np.zeros((rows, size))
    kind = {2: np.int16, 4: np.int32, 8: np.float64}[len(data) // (rows * size)]
    return np.frombuffer(data, kind).reshape(rows, size).astype(np.float64)


def _stacked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per block of a bounded number of rows: its ids, its vectors and, if there, its floors."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        first = {c: [group[c].iloc[0]] for c in keys}
        more = {"floors": [group["floor"].to_numpy(np.float64).tobytes()]} if "floor" in group else {}
        ints = np.array([np.asarray(v, np.float64) for v in group["ints"]])
        return pd.DataFrame(first | {"ids": [group["vec_id"].to_numpy(np.int64).tobytes()], "data": [packed(ints)]} | more)

    schema = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in keys) + ", ids binary, data binary" + (", floors binary" if "floor" in rows.columns else "")
    return rows.groupBy(*keys).applyInPandas(pack, schema)


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY, scale: float = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every` the k rows of greatest product.

    A component x becomes floor(scale x x), computed in double precision; the score is the integer inner product.
    Ties go to the smaller vec_id. A query has fewer results only if there are fewer candidates. Rows whose vector
    is null or holds a null or a component that isn't finite take no part, nor do rows without a vec_id; vectors of
    another length than the query's are no candidates. Rows that repeat the query's vec_id are the query's own.
    Candidates that repeat a vec_id each count. An empty table gives no rows.

    Each query's floor is its k-th best score among the SEEDS longest vectors of its length. Blocks of queries meet
    blocks of one norm bucket; a pair of blocks whose largest possible product is below every floor is left out.
    Both sides are dealt out by the pair, so a large bucket or a long list of queries is many tasks.
    """
    good = cut(
        embeddings.where(F.col("vec_id").isNotNull() & finite(F.col("embedding")))
        .select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("double")).alias("ints"))
        .withColumn("size", F.size("ints"))
        .withColumn("length", F.sqrt(F.aggregate("ints", F.lit(0.0), lambda s, x: s + x * x)))
        .withColumn("bucket", F.floor(F.log(F.greatest("length", F.lit(1.0))) / F.lit(float(np.log(WIDTH)))).cast("int")),
        "lengths",
    )
    sizes = [r["size"] for r in good.select("size").distinct().collect()]
    seeds = {s: good.where(F.col("size") == s).orderBy(F.desc("length"), "vec_id").limit(SEEDS).select("vec_id", "ints").toPandas() for s in sizes}
    seeds = {s: (p["vec_id"].to_numpy(np.int64), np.array([np.asarray(v, np.float64) for v in p["ints"]]).reshape(len(p), s)) for s, p in seeds.items()}

    @F.pandas_udf("double")
    def floor_of(ids: pd.Series, size: pd.Series, ints: pd.Series) -> pd.Series:
        out = []
        for own, s, v in zip(ids, size, ints, strict=True):
            others, rows = seeds[s]
            scores = products(np.asarray(v, np.float64).reshape(1, s), rows)[0][others != own]
            out.append(float(np.sort(scores)[-k]) if len(scores) >= k else float("-inf"))
        return pd.Series(out)

    asked = good.where(F.pmod("vec_id", F.lit(every)) == 0).withColumn("floor", floor_of("vec_id", "size", "ints"))
    counts = good.groupBy("size", "bucket").agg(F.ceil(F.count("*") / VECTORS).cast("int").alias("parts"), F.max("length").alias("longest"))
    lot = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    stack, lots = ["size", "bucket", "part"], ["size", "lot"]
    stacks = cut(_stacked(good.join(counts, ["size", "bucket"]).withColumn("part", (lot % F.col("parts")).cast("int")), stack), "stacks")
    groups = asked.groupBy("size").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    dealt = asked.join(groups, "size").withColumn("lot", (lot % F.col("parts")).cast("int"))
    peaks = dealt.groupBy(lots).agg(F.min(F.when(F.col("length") > 0, F.col("floor") / F.col("length")).otherwise(F.lit(float("-inf")))).alias("least"))
    asks = cut(_stacked(dealt, lots).withColumnsRenamed({"ids": "query_ids", "data": "query_data"}), "asks")
    reachable = F.col("longest") * (1 + 1e-9) >= F.col("least") - 1e-6
    pairs = cut(stacks.select(stack).join(counts, ["size", "bucket"]).join(peaks, "size").where(reachable).select(*stack, "lot"), "pairs")

    def meet(batches):
        for batch in batches:
            for r in batch.to_pylist():
                query_ids, ids = np.frombuffer(r["query_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                queries, vectors = unpacked(r["query_data"], len(query_ids), r["size"]), unpacked(r["data"], len(ids), r["size"])
                q, v, s = search_block(queries, query_ids, np.frombuffer(r["floors"]), vectors, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])

    met = stacks.join(pairs, stack).join(asks.join(pairs, lots), [*stack, "lot"])
    found = met.mapInArrow(meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, (ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""

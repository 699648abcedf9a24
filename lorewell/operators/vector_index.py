"""A kept index of vectors: inverted lists over a coarse quantiser, residual codes, exact cosines for the best of each list.

Lists are folders, so that a search reads the lists that it probes. How many it probes, and which share of a list is
scored exactly, are measured when the index is made, on neighbours of sampled vectors.
"""

from __future__ import annotations

import io
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import snapshots
from ..sources.shared import cut
from .vectors import unit_rows

#: Vectors that the quantisers are fitted on at most, and that neighbours are measured for; every vector is indexed.
SAMPLE, MEASURED = 1 << 16, 256
#: Lists for the square root of the number of vectors, and at most.
DENSITY, LISTS = 1 / 3, 4096
#: Entries of a vector that share a byte of its code.
TOGETHER = 4
#: Neighbours that a search must find, of the NEAREST exact ones.
RECALL, NEAREST = 0.97, 10
#: Vectors of a list, and queries, that meet in one task at a time.
VECTORS, QUERIES = 8192, 1024
MODEL = -1


def means(points: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """k-means centres of the points."""
    centres = points[np.random.default_rng(seed).choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(points, centres)
        sums, counts = np.zeros_like(centres), np.bincount(at, minlength=len(centres))
        np.add.at(sums, at, points)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray, rows: int = 4096) -> np.ndarray:
    """The nearest centre of each point, in slices of bounded size."""
    half = (centres**2).sum(1) / 2
    return np.concatenate([(half - points[i : i + rows] @ centres.T).argmin(1) for i in range(0, len(points), rows)] or [np.zeros(0, int)])


@dataclass(frozen=True)
class Quantiser:
    """Centres of the lists, a codebook for each group of entries, the lists to probe and the share of a list to score."""

    centres: np.ndarray
    books: np.ndarray
    probes: int
    share: float

    @property
    def size(self) -> int:
        return self.centres.shape[1]

    def parts(self, rows: np.ndarray) -> np.ndarray:
        """Rows cut into groups of entries, zeros at the end."""
        width = self.books.shape[0] * self.books.shape[2]
        return np.pad(rows, ((0, 0), (0, width - rows.shape[1]))).reshape(len(rows), self.books.shape[0], self.books.shape[2])

    def coded(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, code) of unit rows."""
        at = nearest(rows, self.centres)
        rest = self.parts(rows - self.centres[at])
        return at, np.stack([nearest(rest[:, m], self.books[m]) for m in range(len(self.books))], 1).astype(np.uint8)

    def order(self, queries: np.ndarray) -> np.ndarray:
        """The lists, nearest first, of each unit query."""
        return ((self.centres**2).sum(1) / 2 - queries @ self.centres.T).argsort(1, kind="stable")

    def estimates(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Estimated cosines of unit queries with the vectors of a list."""
        table = np.einsum("qmd,mcd->qmc", self.parts(queries), self.books)
        return (queries @ self.centres[at])[:, None] + sum(table[:, m][:, codes[:, m]] for m in range(codes.shape[1]))

    def scored(self, rows: int, k: int) -> int:
        """How many of a list's rows are scored exactly: the share measured, and never fewer than are asked for."""
        return min(rows, max(k, int(np.ceil(self.share * rows))))

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, centres=self.centres, books=self.books, measured=np.array([self.probes, self.share]))
        return out.getvalue()

    @staticmethod
    def unpacked(data: bytes) -> Quantiser:
        with np.load(io.BytesIO(data)) as x:
            return Quantiser(x["centres"], x["books"], int(x["measured"][0]), float(x["measured"][1]))


def fitted(sample: np.ndarray, n: int, recall: float = RECALL, k: int = NEAREST, seed: int = 7) -> Quantiser:
    """A quantiser for n unit vectors of which these are a sample.

    For MEASURED of them the k nearest others are found exactly. The lists to probe, and the share of a list to score,
    are the least that hold as many of these neighbours that both together keep `recall` of them.
    """
    lists = int(np.clip(round(n**0.5 * DENSITY), 1, LISTS))
    groups = -(-sample.shape[1] // TOGETHER)
    first = Quantiser(means(sample, lists, seed), np.zeros((groups, 1, TOGETHER)), 1, 1.0)
    rest = first.parts(sample - first.centres[nearest(sample, first.centres)])
    books = [means(rest[:, m], 256, seed + 1 + m) for m in range(groups)]
    books = np.stack([np.pad(b, ((0, min(256, len(sample)) - len(b)), (0, 0)), mode="edge") for b in books])
    made = Quantiser(first.centres, books, 1, 1.0)
    at, codes = made.coded(sample)
    asked = np.random.default_rng(seed).choice(len(sample), min(MEASURED, len(sample)), replace=False)
    places, depths = [], []
    members = [np.flatnonzero(at == i) for i in range(len(made.centres))]
    for q, order in zip(asked, made.order(sample[asked]), strict=True):
        exact = sample @ sample[q]
        exact[q] = -np.inf
        near = np.argsort(-exact, kind="stable")[: min(k, len(sample) - 1)]
        rank = np.empty(len(order), int)
        rank[order] = np.arange(len(order))
        for i in set(at[near]):
            own = members[i]
            guess = made.estimates(sample[q : q + 1], i, codes[own])[0]
            best = (-guess).argsort(kind="stable").argsort()
            depths.extend((best[np.isin(own, near)] + 1) / len(own))
        places.extend(rank[at[near]] + 1)
    if not places:
        return made
    each = recall**0.5
    return Quantiser(made.centres, made.books, int(np.quantile(places, each, method="higher")), float(np.quantile(depths, each, method="higher")))


@dataclass(frozen=True)
class VectorIndex:
    """rows: id, list, code, embedding, embedding_hash and the rows' other columns."""

    rows: DataFrame
    quantiser: Quantiser | None

    def exhaustive(self) -> VectorIndex:
        """The same rows, of which a search asks every list and scores every one."""
        q = self.quantiser
        return self if q is None else replace(self, quantiser=replace(q, probes=len(q.centres), share=1.0))

    def search(self, queries: DataFrame, k: int, keep: Column | None = None, exclude_self: bool = False) -> DataFrame:
        """query_id, id, similarity, rank, scored: about the k rows of greatest cosine for each query, ties to the smaller id.

        queries: (query_id, embedding). `keep` filters the rows where the lists are read. A query that finds fewer than k
        rows in the lists it probed asks twice as many, until it has k or has asked all. `scored` is the number of rows
        whose cosine was taken exactly for the query. Queries without a vector of the index's length find nothing.
        """
        spark, none = queries.sparkSession, "query_id long, id long, similarity double, rank int, scored long"
        if self.quantiser is None:
            return spark.createDataFrame([], none)
        rows = self.rows if keep is None else self.rows.where(keep)
        left, probes, found, n = usable(queries, self.quantiser.size), self.quantiser.probes, None, len(self.quantiser.centres)
        while True:
            best = cut(self._round(left, rows, probes, k, exclude_self), "nearest")
            short = cut(left.join(best.where(F.col("rank") == k).select("query_id"), "query_id", "left_anti"), "short") if probes < n else None
            done = short is None or short.isEmpty()
            own = best if done else best.join(short.select("query_id"), "query_id", "left_anti")
            found = own if found is None else found.unionByName(own)
            if done:
                return found
            left, probes = short, min(2 * probes, n)

    def _round(self, queries: DataFrame, rows: DataFrame, probes: int, k: int, exclude_self: bool) -> DataFrame:
        quantiser = self.quantiser

        @F.pandas_udf("array<int>")
        def probed(batch: pd.Series) -> pd.Series:
            return pd.Series(list(quantiser.order(unit_rows(batch))[:, :probes].astype(np.int32))) if len(batch) else pd.Series([], dtype=object)

        asked = cut(queries.select("query_id", "embedding", F.explode(probed("embedding")).alias("list")), "probes")
        lots = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("lots"))
        parts = rows.groupBy("list").agg(F.ceil(F.count("*") / VECTORS).cast("int").alias("parts"))
        grid = cut(lots.join(parts, "list"), "grid")
        own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        key = ["list", "part", "lot"]
        left = asked.join(grid, "list").withColumn("lot", own("query_id", "lots")).withColumn("part", every("parts")).select(*key, "query_id", "embedding")
        right = rows.join(grid, "list").withColumn("part", own("id", "parts")).withColumn("lot", every("lots")).select(*key, "id", "code", "embedding")

        def meet(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            out = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64"), "scored": pd.Series(dtype="int64")})
            if not len(q) or not len(v):
                return out
            v = v.sort_values("id")
            wanted, units, ids = unit_rows(q["embedding"]), unit_rows(v["embedding"]), v["id"].to_numpy(np.int64)
            guess = quantiser.estimates(wanted, int(v["list"].iloc[0]), np.stack([np.frombuffer(c, np.uint8) for c in v["code"]]))
            count = quantiser.scored(len(v), k + exclude_self)
            top = np.argpartition(-guess, count - 1, axis=1)[:, :count]
            found = []
            for query, unit, rows_of in zip(q["query_id"], wanted, np.sort(top, 1), strict=True):
                exact, own_ids = units[rows_of] @ unit, ids[rows_of]
                if exclude_self:
                    exact, own_ids = exact[own_ids != query], own_ids[own_ids != query]
                order = np.lexsort((own_ids, -exact))[:k]
                found.append(pd.DataFrame({"query_id": query, "id": own_ids[order], "similarity": exact[order], "scored": np.where(np.arange(len(order)) == 0, count, 0)}))
            return pd.concat(found)

        met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, "query_id long, id long, similarity double, scored long")
        best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
        told = met.withColumn("rank", F.row_number().over(best)).withColumn("scored", F.sum("scored").over(Window.partitionBy("query_id")))
        return told.where(F.col("rank") <= k).select("query_id", "id", "similarity", "rank", "scored")


def usable(rows: DataFrame, size: int | None = None) -> DataFrame:
    """Rows whose vector is there, of the length asked for, and holds finite numbers only."""
    e = F.col("embedding")
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.where(F.coalesce(good, F.lit(False)) & (F.size(e) > 0) & (F.lit(True) if size is None else F.size(e) == size))


def read(spark: SparkSession, path: str) -> VectorIndex | None:
    """The latest version, or null if there is none."""
    rows = snapshots.latest(spark, path)
    if rows is None:
        return None
    model = rows.where(F.col("list") == MODEL).select("code").first()
    return VectorIndex(rows.where(F.col("list") != MODEL), Quantiser.unpacked(bytes(model["code"])) if model["code"] else None)


def _hash(rows: DataFrame) -> DataFrame:
    return rows.withColumn("embedding_hash", F.sha2(F.to_json(F.struct("embedding")), 256))


def _write(path: str, coded: DataFrame, quantiser: Quantiser | None) -> VectorIndex:
    """The next version: the rows, and one with the quantiser, which so changes with them in one step."""
    spark = coded.sparkSession
    model = spark.createDataFrame([(quantiser.packed() if quantiser else b"",)], "code binary").withColumn("list", F.lit(MODEL))
    told = coded.unionByName(model, allowMissingColumns=True)
    snapshots.write(told.repartitionByRange("list", "id").sortWithinPartitions("list", "id"), path, ["list"])
    return read(spark, path)


def _coded(rows: DataFrame, quantiser: Quantiser) -> DataFrame:
    @F.pandas_udf("list int, code binary")
    def code(batch: pd.Series) -> pd.DataFrame:
        if not len(batch):
            return pd.DataFrame({"list": pd.Series(dtype="int32"), "code": pd.Series(dtype=object)})
        at, codes = quantiser.coded(unit_rows(batch))
        return pd.DataFrame({"list": at.astype(np.int32), "code": [c.tobytes() for c in codes]})

    return rows.withColumn("_coded", code("embedding")).select(*rows.columns, "_coded.list", "_coded.code")


def build(path: str, rows: DataFrame, recall: float = RECALL) -> VectorIndex:
    """A new version of the index of rows (id, embedding, further columns for filters).

    Rows whose vector is null, empty or not finite are left out, as are those of another length than most; a zero vector has
    cosine 0 with all. The quantisers are fitted on at most SAMPLE rows, chosen by a hash of their ids, on the driver.
    """
    rows = usable(rows)
    size = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if size is None:
        return _write(path, _hash(rows).withColumns({"list": F.lit(0), "code": F.lit(b"")}), None)
    own = rows.where(F.size("embedding") == size["size"])
    sample = own.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    quantiser = fitted(unit_rows(sample["embedding"]), size["count"], recall)
    return _write(path, _coded(_hash(own), quantiser), quantiser)


def update(path: str, rows: DataFrame) -> VectorIndex:
    """The next version, of exactly these rows: new and changed vectors are coded by the quantisers that are there, the others
    keep their codes; other columns are taken from the rows."""
    before = read(rows.sparkSession, path)
    if before is None or before.quantiser is None:
        return build(path, rows)
    own = _hash(usable(rows, before.quantiser.size))
    known = before.rows.select("id", "embedding_hash", "list", "code")
    same = own.join(known, ["id", "embedding_hash"])
    fresh = own.join(known.select("id", "embedding_hash"), ["id", "embedding_hash"], "left_anti")
    return _write(path, same.select(*own.columns, "list", "code").unionByName(_coded(fresh, before.quantiser)), before.quantiser)

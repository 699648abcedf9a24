"""Whitened embeddings: principal components by MLlib's distributed SVD, scaled to unit variance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .vectors import finite

SCALE, SHIFT, COMPONENTS = 64.0, 1_000_000, 16
#: Beyond it a double holds no odd numbers; larger entries count as it.
WHOLE = 2.0**53
#: Components whose singular value is a smaller share of the largest are noise of the arithmetic.
RANK = 1e-7


def whole(embedding: Column, scale: float = SCALE, shift: int = SHIFT) -> Column:
    """x of every entry: floor(scale x entry) + shift, as longs."""
    return F.transform(embedding, lambda c: F.floor(F.greatest(F.lit(-WHOLE), F.least(F.lit(WHOLE), c.cast("double") * F.lit(scale)))) + F.lit(shift))


def sums(vectors: DataFrame, size: int) -> list[int]:
    """The exact sum of each dimension; high and low digits are summed apart, so that neither leaves a long."""
    digits = vectors.select(F.posexplode("x").alias("place", "x"))
    found = digits.groupBy("place").agg(F.sum(F.shiftright("x", 20)).alias("high"), F.sum(F.col("x").bitwiseAND(F.lit((1 << 20) - 1))).alias("low"))
    by = {r["place"]: (int(r["high"]) << 20) + int(r["low"]) for r in found.collect()}
    return [by[i] for i in range(size)]


def offsets(vectors: np.ndarray, n: int, totals: list[int]) -> np.ndarray:
    """n x - S, exactly: in longs where they hold it, else in Python's numbers."""
    most = max(int(np.abs(vectors).max(initial=0)), 1)
    if n * most < 2**62 and max(map(abs, totals), default=0) < 2**62:
        return vectors * np.int64(n) - np.array(totals, np.int64)
    return vectors.astype(object) * n - np.array(totals, dtype=object)


def squares(numbers: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    most = max((abs(int(v)) for v in (numbers.min(initial=0), numbers.max(initial=0))), default=0)
    if numbers.dtype == object or most * most * max(1, numbers.shape[1]) >= 2**63:
        numbers = numbers.astype(object)
    return [int(v) for v in (numbers * numbers).sum(1)]


def matrix(batch: pd.Series) -> np.ndarray:
    return np.stack(batch.tolist()).astype(np.int64, copy=False)


def whitened(embeddings: DataFrame, components: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable row and each component.

    x = floor(scale x entry) + shift. The fit list is each different x once: n vectors with sums S. Components are the
    eigenvectors of its covariance (divisor n), by falling eigenvalue e; the entry of largest size is positive, which
    settles the sign. `whitened` is (x - S/n) on the component over the root of e, `explained` e over the total
    variance, `deviation` the exact sum of (n x - S) squared, null if no long holds it, `identity_error` the largest
    entry of the covariance of `whitened` over the fit list minus the identity.

    Rows whose vector is null, or holds a null or an entry that isn't finite, are dropped. Entries beyond 2 ** 53 after
    scaling count as that. Vectors of each length are fitted for themselves. A vector without entries has no
    components, nor have vectors that are all equal; fewer components than asked for remain if the vectors span
    fewer. Rows that repeat a vec_id, or have none, each get their rows. An empty table gives no rows.

    Rows are centred before they are multiplied, as (n x - S) / n from whole numbers. The covariance is summed where
    the rows are; what the driver holds grows with the square of the dimensions only.
    """
    rows = embeddings.where(finite(F.col("embedding")) & (F.size("embedding") > 0)).select("vec_id", whole(F.col("embedding"), scale, shift).alias("x"))
    rows = cut(rows, "whole")
    fit = cut(rows.select("x").distinct(), "fit")
    out = None
    for size in sorted(r["size"] for r in fit.select(F.size("x").alias("size")).distinct().collect()):
        part = _whitened(rows.where(F.size("x") == size), fit.where(F.size("x") == size), size, components)
        out = part if out is None or part is None else out.unionByName(part)
    return out if out is not None else embeddings.sparkSession.createDataFrame([], f"vec_id {dict(embeddings.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def _whitened(rows: DataFrame, fit: DataFrame, size: int, components: int) -> DataFrame | None:
    n = fit.count()
    totals = sums(fit, size)

    @F.pandas_udf("array<double>")
    def centred(x: pd.Series) -> pd.Series:
        return pd.Series(list(offsets(matrix(x), n, totals).astype(np.float64) / n)) if len(x) else pd.Series([], dtype=object)

    @F.pandas_udf("double")
    def spread(x: pd.Series) -> pd.Series:
        return pd.Series([float(v) for v in squares(offsets(matrix(x), n, totals))] if len(x) else [], dtype="float64")

    vectors = cut(fit.select(centred("x").alias("row"), spread("x").alias("spread")), "centred")
    total = vectors.agg(F.sum("spread")).first()[0] / n / n / n
    svd = row_matrix(vectors.select("row"), n, size).computeSVD(size, rCond=RANK) if total > 0 else None
    variance = svd.s.toArray()[:components] ** 2 / n if svd else np.zeros(0)
    axes = svd.V.toArray()[:, : len(variance)] if svd else np.zeros((size, 0))
    if not len(variance):
        return None
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    scaled, shares = axes / np.sqrt(variance), (variance / total).tolist()

    @F.pandas_udf("array<double>")
    def projected(row: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(row.tolist()) @ scaled)) if len(row) else pd.Series([], dtype=object)

    @F.pandas_udf("deviation decimal(38,0), whitened array<double>")
    def both(x: pd.Series) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame({"deviation": [], "whitened": []})
        numbers = offsets(matrix(x), n, totals)
        exact = [v if v < 2**63 else None for v in squares(numbers)]
        return pd.DataFrame({"deviation": exact, "whitened": list(numbers.astype(np.float64) / n @ scaled)})

    error = identity_error(vectors.select(projected("row").alias("row")), n, len(variance))
    found = rows.select("vec_id", both("x").alias("both")).select("vec_id", F.col("both.deviation").cast("long").alias("deviation"), F.posexplode("both.whitened").alias("at", "whitened"))
    return found.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(F.array(*map(F.lit, shares)), "at").alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def row_matrix(rows: DataFrame, n: int, size: int) -> RowMatrix:
    """MLlib's matrix of rows of arrays."""
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("row").alias("row")), "row"), n, size)


def identity_error(rows: DataFrame, n: int, size: int) -> float:
    """Largest entry, by size, of the rows' covariance, divisor n, minus the identity; centred before multiplying."""
    means = rows.select([F.avg(F.col("row")[i]) for i in range(size)]).first()
    centred = rows.select(F.array(*[F.col("row")[i] - F.lit(float(m)) for i, m in enumerate(means)]).alias("row"))
    return float(np.abs(row_matrix(centred, n, size).computeGramianMatrix().toArray() / n - np.eye(size)).max())

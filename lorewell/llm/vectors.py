"""What the vector operators share: which vectors count, and blocks of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(embedding: Column) -> Column:
    """True if the vector is there and every component is a finite number (an empty vector passes)."""
    return F.coalesce(F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False))


def nonzero(embedding: Column) -> Column:
    return F.exists(embedding, lambda x: x != 0)

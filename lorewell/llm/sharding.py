"""Reproducible shuffle into shards: a Feistel permutation over global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

#: Rows are numbered within so many hash buckets; the buckets' counts (at most this many) are all that is broadcast.
BUCKETS = 1024
ROUNDS = 6


def permute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A permutation of 0..n-1, applied to each number of x.

    A balanced Feistel network permutes 0..4^h-1 for the smallest such power of four that holds n; a number that
    lands at n or above goes through the network again until it lands below (cycle walking), on average less than
    four times.
    """
    half = 1
    while 4**half < n:
        half += 1
    mask = np.uint64(2**half - 1)
    keys = [np.uint64(k) for k in np.random.default_rng(seed).integers(0, 2**63, ROUNDS, dtype=np.uint64)]

    def network(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & mask
        for key in keys:
            mixed = (right ^ key) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask)
        return (left << np.uint64(half)) | right

    with np.errstate(over="ignore"):
        out = network(x.astype(np.uint64))
        while (far := out >= n).any():
            out[far] = network(out[far])
    return out.astype(np.int64)


def shard_rows(rows: DataFrame, ids: list[str], shards: int = 16, seed: int = 7) -> DataFrame:
    """The rows with `row_number`, `shard` and `slot` added; columns of these names in the input are replaced.

    Global row numbers follow from the values of the columns `ids` alone: rows are put into BUCKETS buckets by a
    hash of the ids, numbered inside a bucket in the order of the ids, and offset by the counts of the buckets
    before. A rerun, or a task run again after an executor is lost, gives each row the same number. The permuted
    number p gives shard p mod shards and slot p div shards: shard sizes differ by one at most and slots have no
    gaps. Rows equal in all ids (nulls are equal) exchange their numbers freely, which nobody can tell. An empty
    table gives an empty result.
    """
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ids])
    kept = [c for c in rows.columns if c not in ("row_number", "shard", "slot")]
    placed = rows.select(F.struct(*rows.columns).alias("_row"), *ids).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), total, seed))

    within = Window.partitionBy("_bucket").orderBy(*[F.col(c).asc_nulls_first() for c in ids])
    numbered = (
        placed.withColumn("_within", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn("row_number", F.col("_offset") + F.col("_within"))
        .withColumn("_place", place("row_number"))
    )
    shard, slot = (F.col("_place") % shards).cast("int"), F.floor(F.col("_place") / shards).cast("long")
    return numbered.select(*[F.col("_row")[c].alias(c) for c in kept], "row_number", shard.alias("shard"), slot.alias("slot"))


def shard_documents(documents: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document.

    The law is `rows`: a shard's row count is at most one from any other's. The size is the text's UTF-8 bytes plus
    one (null text: one, and its checksum is that of no bytes). grown_shard is null under this law. Repeated rows
    each get a place of their own. Other columns of the input are ignored. What the numbering needs of a row is
    written to the shared folder once, so that texts are read only once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard_rows(cut(slim, "shard-input"), ["doc_id", "text_crc32", "size"], shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

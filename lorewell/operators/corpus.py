"""Listings, summaries and structural checks of corpus rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that listings return: never the text, never the vector.
LIGHT = ("id", "type", "title", "source_type", "project", "status", "created_at", "access_count")


def where(rows: DataFrame, **equal) -> DataFrame:
    """Rows that equal every given value; a row without a project belongs to all of them; `since` bounds created_at."""
    for name, value in equal.items():
        if value is None:
            continue
        if name == "since":
            rows = rows.where(F.col("created_at") >= F.lit(value).cast("timestamp_ntz"))
        elif name == "project":
            rows = rows.where((F.col("project") == value) | F.col("project").isNull())
        else:
            rows = rows.where(F.col(name) == value)
    return rows


def not_history(parent_id: Column, status: Column) -> Column:
    """False for superseded chunks, which only count when a status is asked for."""
    return ~(parent_id.isNotNull() & status.eqNullSafe(F.lit("superseded")))


def many(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of (position, id), in that order; ids without a row are left out."""
    return rows.join(ids, "id").orderBy("position")


def page(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit).select(*LIGHT)


def arrivals(rows: DataFrame) -> DataFrame:
    """Documents and memories by channel; rows without a source are labelled by their type."""
    label = F.coalesce("source_type", F.concat(F.lit("generated:"), F.col("type")))
    return rows.groupBy(label.alias("label")).agg(
        F.countDistinct(F.when(F.col("parent_id").isNull(), F.col("id")).otherwise(F.col("parent_id"))).alias("documents"), F.count("*").alias("memories")
    )


def newest_per(rows: DataFrame, key: str, k: int) -> DataFrame:
    newest = Window.partitionBy(key).orderBy(F.desc("created_at"), "id")
    return rows.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= k)


def duplicate_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """key columns, the id that stays (the oldest), and the group's size, for groups of two or more."""
    return rows.groupBy(*keys).agg(F.min_by("id", F.struct("created_at", "id")).alias("keep"), F.count("*").alias("copies")).where("copies > 1")


def parents_without_chunks(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows that stand for themselves in lexical search: no active child does."""
    return rows.join(chunks.where("status = 'active'").select(F.col("parent_id").alias("_parent")), F.col("id") == F.col("_parent"), "left_anti")


def collapse_chunks(chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """Chunks whose parent is not among the rows, which have been filtered like the chunks."""
    return chunks.join(parents.select(F.col("id").alias("_parent")), F.col("parent_id") == F.col("_parent"), "left_anti")


def oversize(rows: DataFrame, limit: int) -> DataFrame:
    return rows.where(F.length("content") > limit).select("id", F.length("content").alias("length"))


def tag_histogram(rows: DataFrame, limit: int) -> DataFrame:
    return rows.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(limit)


def centroids(vectors: DataFrame, key: str) -> DataFrame:
    """Mean vector of each key, coordinate by coordinate: partial sums before the shuffle, no vector lists."""
    parts = vectors.select(key, F.posexplode("embedding").alias("at", "x")).groupBy(key, "at").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "mean"))), lambda s: s["mean"]).alias("centroid"))


def stream_digest(rows: DataFrame) -> DataFrame:
    """Identity, length and hash of each text, never the text."""
    return rows.select("id", "source_type", "status", F.length("content").alias("length"), F.sha2(F.col("content").cast("binary"), 256).alias("hash"))


#: Fixed channels whose rows are derived from others and never merged.
DERIVED = ("codex_task", "distilled_agent_task", "distilled_chat", "dream_cycle")


def dedup_plan(rows: DataFrame, derived: tuple[str, ...] = DERIVED) -> DataFrame:
    """old_id, new_id, pass: captured sources that repeat an older one; those of chunks (pass 1) come before those of parents (2).

    rows: (id, parent_id, type, source_type, url, project, status, record_kind, chunk_index, content, created_at). Only rows of type
    source with an address, without a record kind and of no derived channel may merge. Rows are alike by channel, address,
    project, type, parent, place among chunks, hash of the content and status; the oldest stays, ties to the smaller id.
    Chunks of merged parents have the surviving one for parent, and a repeated paragraph at another place stays.
    """
    own = (F.col("type") == "source") & (F.coalesce("url", F.lit("")) != "") & ~F.coalesce(F.col("source_type").isin(*derived), F.lit(False)) & (F.coalesce("record_kind", F.lit("")) == "")
    kept = rows.where(own).withColumn("hash", F.sha2(F.col("content").cast("binary"), 256)).drop("content")
    alike = ["source_type", "url", "project", "type", "chunk_index", "hash", "status"]
    first = lambda *keys: F.first("id").over(Window.partitionBy(*keys).orderBy("created_at", "id"))
    parents = kept.where("parent_id IS NULL").select("id", first(*alike).alias("new_id"))
    pieces = kept.where("parent_id IS NOT NULL").join(parents.withColumnsRenamed({"id": "parent_id", "new_id": "_canonical"}), "parent_id", "left")
    pieces = pieces.withColumn("_canonical", F.coalesce("_canonical", "parent_id")).select("id", first("_canonical", *alike).alias("new_id"))
    return pieces.withColumn("pass", F.lit(1)).unionByName(parents.withColumn("pass", F.lit(2))).where("id <> new_id").withColumnRenamed("id", "old_id")

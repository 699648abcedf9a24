"""Typed edges: neighbours, expiry, merging, paths of supersession."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SYMMETRIC = ("contradicts", "relates_to", "related_to")
PROVENANCE = ("derived_from", "schema_contains")


def live(edges: DataFrame, as_of: str) -> DataFrame:
    return edges.where(F.col("expired_at").isNull() | (F.col("expired_at") > F.lit(as_of).cast("timestamp_ntz")))


def oriented(edges: DataFrame) -> DataFrame:
    """Symmetric relations with the smaller end first."""
    symmetric = F.col("relation").isin(*SYMMETRIC)
    first = F.when(symmetric, F.least("source_id", "target_id")).otherwise(F.col("source_id"))
    last = F.when(symmetric, F.greatest("source_id", "target_id")).otherwise(F.col("target_id"))
    return edges.withColumns({"source_id": first, "target_id": last})


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """One edge for each (source, target, relation): an edge to itself is refused, the first creation stays, the
    latest note that isn't null stays, and a new sighting clears the expiry."""
    known = oriented(stored).select("*", F.lit(0).alias("turn"))
    fresh = oriented(new).where("source_id <> target_id").withColumn("expired_at", F.lit(None).cast("timestamp_ntz")).select("*", F.lit(1).alias("turn"))
    latest = F.struct("turn", "created_at", F.coalesce("note", F.lit("")))
    return known.unionByName(fresh).groupBy("source_id", "target_id", "relation").agg(
        F.max_by("note", F.when(F.col("note").isNotNull(), latest)).alias("note"), F.min("created_at").alias("created_at"), F.when(F.max("turn") == 0, F.max_by("expired_at", F.struct(F.col("expired_at").isNull(), "expired_at"))).alias("expired_at")
    )


def merge(edges: DataFrame) -> DataFrame:
    """Edges that coincide after ids were mapped: earliest creation, open if any is open, else the latest expiry.

    Notes are appended line by line: those of edges that stood there before (not `moved`, if there is such a column),
    then by creation.
    """
    open_ended = F.max(F.col("expired_at").isNull())
    moved = F.col("moved") if "moved" in edges.columns else F.lit(False)
    notes = F.array_sort(F.collect_list(F.when(F.col("note").isNotNull(), F.struct(moved.alias("moved"), "created_at", "note"))))
    lines = F.array_join(F.transform(notes, lambda n: n["note"]), "\n")
    return (
        oriented(edges)
        .where("source_id <> target_id")
        .groupBy("source_id", "target_id", "relation")
        .agg(F.min("created_at").alias("created_at"), F.when(~open_ended, F.max("expired_at")).alias("expired_at"), F.when(F.count("note") > 0, lines).alias("note"), F.count("*").alias("merged"))
    )


def remap(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Both ends by (id, survivor), then merged."""
    edges = edges.withColumn("moved", F.lit(False))
    for end in ("source_id", "target_id"):
        ids = mapping.select(F.col("id").alias(end), F.col("survivor").alias("_to"))
        to = F.coalesce("_to", end)
        edges = edges.join(ids, end, "left").withColumns({"moved": F.col("moved") | (to != F.col(end)), end: to}).drop("_to")
    return merge(edges)


def neighbours(edges: DataFrame, rows: DataFrame, as_of: str, include_expired: bool = False) -> DataFrame:
    """id, other, relation, direction, note, created_at, expired_at, title, status: edges from either end of each row.

    One for each other row, relation and direction, both directions of a symmetric relation being one: a live one
    before an expired one, of these the one that expired first, then the newest, then the smaller source and target.
    Without include_expired only live edges count.
    """
    kept = edges if include_expired else live(edges, as_of)
    columns = ["relation", "note", "created_at", "expired_at", "source_id", "target_id"]
    both = kept.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), F.lit("out").alias("way"), *columns).unionByName(
        kept.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), F.lit("in").alias("way"), *columns)
    )
    way = F.when(F.col("relation").isin(*SYMMETRIC), "both").otherwise(F.col("way"))
    second = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    order = F.struct(F.coalesce(second("expired_at"), F.lit(-(2**62))), -second("created_at"), "source_id", "target_id")
    best = both.withColumn("direction", way).groupBy("id", "other", "relation", "direction").agg(F.min_by(F.struct("note", "created_at", "expired_at"), order).alias("_edge"))
    return best.select("id", "other", "relation", "direction", "_edge.*").join(rows.select(F.col("id").alias("other"), "title", "status"), "other")


def stale(edges: DataFrame, used: DataFrame, as_of: str, older: int = 90) -> DataFrame:
    """Live edges older than so many days, without provenance, neither of whose ends is in `used` (ids)."""
    old = live(edges, as_of).where((F.col("created_at") < F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(older))) & ~F.col("relation").isin(*PROVENANCE))
    ids = used.select(F.col("id").alias("_used")).distinct()
    return old.join(ids, F.col("source_id") == F.col("_used"), "left_anti").join(ids, F.col("target_id") == F.col("_used"), "left_anti")


def pairs(edges: DataFrame, rows: DataFrame, relation: str, as_of: str) -> DataFrame:
    """a, b, title_a, title_b, created_at: the rows at both ends of live edges of a relation, both active."""
    side = lambda s: rows.where("status = 'active'").select(F.col("id").alias(s), F.col("title").alias(f"title_{s}"))
    kept = live(edges, as_of).where(F.col("relation") == relation).groupBy(F.col("source_id").alias("a"), F.col("target_id").alias("b")).agg(F.max("created_at").alias("created_at"))
    return kept.join(side("a"), "a").join(side("b"), "b")


def constituents(edges: DataFrame, rows: DataFrame, relation: str, k: int, as_of: str) -> DataFrame:
    """id, member, rank: the newest k rows that each row contains."""
    newest = Window.partitionBy("source_id").orderBy(F.desc("created_at"), "target_id")
    found = live(edges, as_of).where(F.col("relation") == relation).select("source_id", "target_id").distinct()
    return (
        found.join(rows.select(F.col("id").alias("target_id"), "created_at"), "target_id")
        .withColumn("rank", F.row_number().over(newest))
        .where(F.col("rank") <= k)
        .select(F.col("source_id").alias("id"), F.col("target_id").alias("member"), "rank")
    )


def superseded(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows that an edge says are superseded."""
    return rows.join(edges.where("relation = 'supersedes'").select(F.col("target_id").alias("id")), "id", "left_semi")


def within_a_day(rows: DataFrame, k: int, hours: int = 24) -> DataFrame:
    """id, other, gap (seconds), rank: the k rows nearest in time, at most `hours` apart, of the same channel.

    A range join by buckets of that width: each row meets only rows of its own bucket and the two beside it.
    """
    width = hours * 3600
    second = F.unix_timestamp(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
    timed = rows.select("id", "source_type", second.alias("at")).withColumn("bucket", F.floor(F.col("at") / width))
    left = timed.withColumn("bucket", F.explode(F.array(*[F.col("bucket") + d for d in (-1, 0, 1)])))
    right = timed.select(F.col("id").alias("other"), "source_type", F.col("at").alias("then"), "bucket")
    nearest = Window.partitionBy("id").orderBy("gap", "other")
    met = left.join(right, ["source_type", "bucket"]).where("id <> other").withColumn("gap", F.abs(F.col("at") - F.col("then")))
    return met.where(F.col("gap") <= width).withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("id", "other", "gap", "rank")

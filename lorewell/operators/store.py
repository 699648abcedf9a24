"""Snapshots: every change reads a version of a table and gives the rows of the next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_latest(stored: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the one with the greatest `order`; new rows win ties."""
    both = stored.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)))
    columns = [c for c in stored.columns if c not in keys]
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order, "_turn")).alias("_row"))
    return last.select(*keys, "_row.*").select(*stored.columns)


def delete(stored: DataFrame, keys: DataFrame) -> DataFrame:
    return stored.join(keys, keys.columns, "left_anti")


def patch(stored: DataFrame, patches: DataFrame, key: str, merged: tuple[str, ...] = ()) -> DataFrame:
    """Columns of the patches that aren't null replace the stored ones; `merged` columns are maps, the patch's keys win."""
    names = [c for c in patches.columns if c != key]
    rows = stored.join(patches.withColumnsRenamed({c: f"_new_{c}" for c in names}), key, "left")
    for c in names:
        new, old = F.col(f"_new_{c}"), F.col(c)
        if c in merged:
            rows = rows.withColumn(c, merged_map(old, new, stored.schema[c].dataType))
        else:
            rows = rows.withColumn(c, F.coalesce(new, old))
    return rows.select(*stored.columns)


def merged_map(old: Column, new: Column, kind) -> Column:
    """The old entries that the new map lacks, and the new ones; a null new map changes nothing."""
    kept = F.map_filter(F.coalesce(old, F.create_map().cast(kind)), lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    return F.when(new.isNull(), old).otherwise(F.map_concat(kept, new))


def bump(stored: DataFrame, uses: DataFrame) -> DataFrame:
    """access_count plus the number of times each id was used; last_accessed_at becomes the last of them, and never earlier
    than it was. Rows that weren't used stay as they are."""
    counts = uses.groupBy("id").agg(F.count("*").alias("_n"), F.max("at").alias("_at"))
    used = {"access_count": F.coalesce("access_count", F.lit(0)) + F.coalesce("_n", F.lit(0)), "last_accessed_at": F.greatest("last_accessed_at", "_at")}
    return stored.join(counts, "id", "left").withColumns(used).drop("_n", "_at")


def replace_by(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The stored rows of every key that the new rows don't have, and the new rows."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def body_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def ingest_actions(staged: DataFrame, stored: DataFrame) -> DataFrame:
    """source_type, url, action: each identity of the batch once (its last row), new, changed, or unchanged by hash.

    Tags are joined, the stored ones first; a null project never erases a stored one.
    """
    last = Window.partitionBy("source_type", "url").orderBy(F.desc("position"))
    once = staged.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    old = stored.select("source_type", "url", F.col("id").alias("stored_id"), body_hash(F.col("content")).alias("_hash"), F.col("tags").alias("_tags"), F.col("project").alias("_project"))
    joined = once.join(old, ["source_type", "url"], "left")
    action = F.when(F.col("stored_id").isNull(), "new").when(F.col("_hash") == body_hash(F.col("content")), "unchanged").otherwise("changed")
    tags = F.array_distinct(F.concat(F.coalesce("_tags", F.array().cast("array<string>")), F.coalesce("tags", F.array().cast("array<string>"))))
    return joined.select("source_type", "url", "stored_id", action.alias("action"), tags.alias("tags"), F.coalesce("project", "_project").alias("project"), "content")


def next_snapshot(stored: DataFrame, children: DataFrame, actions: DataFrame, pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next versions of rows and children after an ingest.

    Changed identities get their new text, and their children are superseded; `pieces` (source_type, url,
    chunk_index, content) become the active children of new and changed ones.
    """
    same = actions.where("action <> 'new'").select(F.col("stored_id").alias("id"), F.when(F.col("action") == "changed", F.col("content")).alias("content"), "tags", "project")
    fresh = actions.where("action = 'new'").select((F.xxhash64("source_type", "url")).alias("id"), "source_type", "url", "content", "tags", "project")
    rows = patch(stored, same, "id").unionByName(fresh, allowMissingColumns=True)
    changed = actions.where("action = 'changed'").select(F.col("stored_id").alias("parent_id"))
    old = children.join(changed.withColumn("_changed", F.lit(True)), "parent_id", "left").withColumn("status", F.when(F.col("_changed"), "superseded").otherwise(F.col("status"))).drop("_changed")
    ids = actions.where("action <> 'unchanged'").select("source_type", "url", F.coalesce("stored_id", F.xxhash64("source_type", "url")).alias("parent_id"))
    made = pieces.join(ids, ["source_type", "url"]).select(F.xxhash64("parent_id", "chunk_index", body_hash(F.col("content"))).alias("id"), "parent_id", "chunk_index", "content", F.lit("active").alias("status"))
    return rows, old.unionByName(made, allowMissingColumns=True)


def reconcile(stored: DataFrame, selected: DataFrame, low: float = 0.45, high: float = 0.55) -> DataFrame:
    """id, prefix, decision of every stored or selected item of an outside source.

    selected: (id, confidence); stored: (id, prefix, status). Retire an active item that is gone or below `low`,
    reactivate a retired one at `high` or above, create an unknown one at `high` or above; between the two bounds
    nothing changes. If a prefix would lose more than a tenth of its active items, and more than 25, its
    retirements are withheld.
    """
    both = stored.join(selected, "id", "full")
    active = F.coalesce(F.col("status") == "active", F.lit(False))
    gone = F.col("confidence").isNull() | (F.col("confidence") < low)
    high_enough = F.coalesce(F.col("confidence") >= high, F.lit(False))
    decision = F.when(active & gone, F.when(F.col("confidence").isNull(), "deleted").otherwise("below")).when(F.col("status").isNull() & high_enough, "create").when(~active & F.col("status").isNotNull() & high_enough, "reactivate").otherwise("keep")
    marked = both.withColumn("decision", decision)
    totals = stored.groupBy("prefix").agg(F.count_if(F.col("status") == "active").alias("_active"))
    losses = marked.where(F.col("decision").isin("deleted", "below")).groupBy("prefix").agg(F.count("*").alias("_lost"))
    guard = totals.join(losses, "prefix").where(F.col("_lost") > F.greatest(F.lit(25), F.floor(F.col("_active") / 10))).select("prefix", F.lit(True).alias("_held"))
    return marked.join(guard, "prefix", "left").select("id", "prefix", F.when(F.col("_held") & F.col("decision").isin("deleted", "below"), "withheld").otherwise(F.col("decision")).alias("decision"))


def cited_ids(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct ids that candidates cite or edges touch."""
    return candidates.select(F.explode("source_ids").alias("id")).union(edges.select("source_id")).union(edges.select("target_id")).distinct()


def ids_in_text(rows: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """(row id, cited): UUIDs found in a text column, as far as they are known."""
    pattern = r"(?i)\b([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\b"
    found = rows.select("id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(1)), F.lower))).alias("cited"))
    return found.join(known.select(F.col("id").alias("cited")), "cited", "left_semi").select("id", "cited")


def archive_then_delete(stored: DataFrame, doomed: DataFrame, key: str, path: str) -> DataFrame:
    """The rows without the doomed ones, which are first written to the path and counted there.

    Fails if the archive is there already or does not hold as many rows as are to go.
    """
    gone = stored.join(doomed.select(key), key, "left_semi")
    gone.write.mode("errorifexists").parquet(path)
    if stored.sparkSession.read.parquet(path).count() != gone.count():
        raise RuntimeError(f"the archive in {path} is not complete; nothing was deleted")
    return stored.join(doomed.select(key), key, "left_anti")

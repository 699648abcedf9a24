"""Repairs of a corpus: plans are rows, and what they change is decided again against the rows as they are now."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The form of an id in texts and JSON.
UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
IDENTITY = ("source_type", "url", "project", "type", "parent_id", "record_kind", "chunk_index")


def identity(prefix: str = ""):
    """The seven fields that tell a captured row from another, as one value; absent ones are empty."""
    return F.to_json(F.struct(*[F.coalesce(F.col(prefix + c).cast("string"), F.lit("")).alias(c) for c in IDENTITY]))


def content_hash(column: str = "content"):
    return F.sha2(F.col(column).cast("binary"), 256)


def verified_dedup(plan: DataFrame, rows: DataFrame, done: DataFrame) -> DataFrame:
    """old_id, new_id, state of a plan (old_id, new_id, hash, status, identity, keeper_identity): apply; or done (it is in the
    ledger), gone, content, status, identity: what has changed since it was made."""
    now = rows.select("id", content_hash().alias("hash"), "status", identity().alias("identity"))
    side = lambda name, key: now.withColumnsRenamed({c: f"_{name}_{c}" for c in now.columns}).withColumnRenamed(f"_{name}_id", key)
    both = plan.join(side("old", "old_id"), "old_id", "left").join(side("new", "new_id"), "new_id", "left").join(done.select("old_id", F.lit(True).alias("_done")).distinct(), "old_id", "left")
    state = (
        F.when(F.col("_done"), "done")
        .when(F.col("_old_hash").isNull() | F.col("_new_hash").isNull(), "gone")
        .when((F.col("_old_hash") != F.col("hash")) | (F.col("_new_hash") != F.col("hash")), "content")
        .when((F.col("_old_status") != F.col("status")) | (F.col("_new_status") != F.col("status")), "status")
        .when((F.col("_old_identity") != F.col("identity")) | (F.col("_new_identity") != F.col("keeper_identity")), "identity")
        .otherwise("apply")
    )
    return both.select("old_id", "new_id", state.alias("state"))


def apply_dedup(verified: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, ledger): merged rows go, their fields but the text are kept on the survivor as `aliases`, in the
    order of their ids, and children of a merged row get the survivor for parent."""
    moved = verified.where("state = 'apply'").select("old_id", "new_id")
    archive = F.to_json(F.struct(*[c for c in rows.columns if c not in ("content", "embedding", "aliases")]))
    gone = rows.join(moved, rows.id == moved.old_id).groupBy(F.col("new_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("old_id", archive.alias("row")))), lambda s: s["row"]).alias("_aliases"))
    kept = rows.join(moved.select(F.col("old_id").alias("id")), "id", "left_anti").join(gone, "id", "left")
    old = F.col("aliases") if "aliases" in rows.columns else F.lit(None).cast("array<string>")
    kept = kept.withColumn("aliases", F.when(F.col("_aliases").isNotNull(), F.concat(F.coalesce(old, F.array().cast("array<string>")), "_aliases")).otherwise(old)).drop("_aliases")
    above = moved.select(F.col("old_id").alias("parent_id"), F.col("new_id").alias("_parent"))
    kept = kept.join(above, "parent_id", "left").withColumn("parent_id", F.coalesce("_parent", "parent_id")).drop("_parent")
    return kept, moved.withColumn("kind", F.lit("dedup"))


def referenced(ids: DataFrame, columns: list[DataFrame], arrays: list[DataFrame], texts: list[DataFrame]) -> DataFrame:
    """The ids that something cites: a column of ids, an array of ids, or an id inside of JSON or prose, in any case.

    ids: (id string); columns, arrays, texts: one-column tables. Each is read once, whatever the number of ids.
    """
    cited = [c.select(F.lower(F.col(c.columns[0]).cast("string")).alias("id")) for c in columns]
    cited += [a.select(F.explode(a.columns[0]).alias("id")).select(F.lower(F.col("id").cast("string")).alias("id")) for a in arrays]
    cited += [t.select(F.explode(F.regexp_extract_all(F.lower(F.col(t.columns[0])), F.lit(f"({UUID})"), F.lit(1))).alias("id")) for t in texts]
    every = cited[0]
    for c in cited[1:]:
        every = every.unionByName(c)
    return ids.join(every, F.lower(ids.id) == every.id, "left_semi")


def purge(chunks: DataFrame, cited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks that stay, counts by parent): superseded chunks that nothing cites go."""
    marked = chunks.join(cited.select("id", F.lit(True).alias("_cited")).distinct(), "id", "left")
    doomed = (F.col("status") == "superseded") & F.col("_cited").isNull()
    counts = marked.where("status = 'superseded'").groupBy("parent_id").agg(F.count_if(F.col("_cited").isNull()).alias("deleted"), F.count("_cited").alias("retained"))
    return marked.where(~doomed).drop("_cited"), counts


def metadata_repairs(rows: DataFrame, runs: DataFrame, candidates: DataFrame) -> DataFrame:
    """kind, key, project, accepted, rejected: projects that are bare ids, and runs whose counters aren't those of their
    candidates. runs: (run_id, candidates_accepted, candidates_rejected); candidates: (run_id, verdict)."""
    ids = rows.where(F.lower("project").rlike(f"^{UUID}$")).select(F.lit("project").alias("kind"), F.col("id").cast("string").alias("key"), "project", F.lit(None).cast("long").alias("accepted"), F.lit(None).cast("long").alias("rejected"))
    counts = candidates.groupBy("run_id").agg(F.count_if(F.col("verdict") == "ACCEPTED").alias("accepted"), F.count_if(F.col("verdict") == "REJECTED").alias("rejected"))
    both = runs.join(counts, "run_id", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("accepted", "rejected")})
    wrong = ~F.col("candidates_accepted").eqNullSafe(F.col("accepted")) | ~F.col("candidates_rejected").eqNullSafe(F.col("rejected"))
    return ids.unionByName(both.where(wrong).select(F.lit("counters").alias("kind"), F.col("run_id").cast("string").alias("key"), F.lit(None).cast("string").alias("project"), "accepted", "rejected"))


def repaired_projects(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows with planned projects taken off, kept as legacy_project; a row whose project has changed since stays."""
    told = plan.where("kind = 'project'").select(F.col("key").alias("_key"), F.col("project").alias("_planned"))
    both = rows.join(told, rows.id.cast("string") == F.col("_key"), "left")
    hit = F.col("_planned").isNotNull() & (F.col("project") == F.col("_planned"))
    return both.withColumn("legacy_project", F.when(hit, F.col("_planned"))).withColumn("project", F.when(~F.coalesce(hit, F.lit(False)), F.col("project"))).drop("_key", "_planned")


def applied_rechunk(plans: DataFrame, expected: DataFrame, stored: DataFrame) -> DataFrame:
    """parent_id, chunk_index, hash, status after a plan (parent_id, plan) is carried out: complete parents keep their
    pieces; others' pieces are superseded, and but for cleared ones and leaves the expected ones stand active beside them."""
    new = expected.join(plans.where("plan = 'needs'"), "parent_id", "left_semi").withColumn("status", F.lit("active"))
    old = stored.join(plans, "parent_id", "left").withColumn("status", F.when(F.coalesce("plan", F.lit("complete")) == "complete", "active").otherwise("superseded"))
    return old.select("parent_id", "chunk_index", "hash", "status").unionByName(new.select("parent_id", "chunk_index", "hash", "status"))


def retired(rows: DataFrame, children: DataFrame, decisions: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(rows, children) after decisions (id, action, reason): an active row that is retired, and its active children, are
    superseded with the reason and the time; a restored row, and those of its children that were retired, are active
    again without them; anything else stays."""
    now = F.lit(at).cast("timestamp_ntz")

    def after(df: DataFrame, key: str) -> DataFrame:
        told = decisions.select(F.col("id").alias("_id"), F.col("action").alias("_action"), F.col("reason").alias("_reason"))
        both = df.join(told, F.col(key) == F.col("_id"), "left")
        down = (F.col("_action") == "retire") & (F.col("status") == "active")
        up = (F.col("_action") == "restore") & (F.col("status") == "superseded") & F.col("retired_reason").isNotNull()
        changed = {
            "retired_reason": F.when(down, F.col("_reason")).when(up, None).otherwise(F.col("retired_reason")),
            "retired_at": F.when(down, now).when(up, None).otherwise(F.col("retired_at")),
            "status": F.when(down, "superseded").when(up, "active").otherwise(F.col("status")),
        }
        return both.withColumns(changed).drop("_id", "_action", "_reason")

    return after(rows, "id"), after(children, "parent_id")


def reason_counts(decisions: DataFrame, reasons: tuple[str, ...]) -> DataFrame:
    """reason, n of what is retired, every stated reason having a row."""
    named = decisions.sparkSession.createDataFrame([(r,) for r in reasons], "reason string")
    counts = decisions.where("action = 'retire'").groupBy("reason").agg(F.count("*").alias("n"))
    return named.join(counts, "reason", "left").select("reason", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def inserted_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates as they are stored: a target that is no id becomes null; ids are lower case."""
    good = F.lower(F.trim("target"))
    return candidates.withColumn("target", F.when(good.rlike(f"^{UUID}$"), good))


def expired(edges: DataFrame, doomed: DataFrame, at: str) -> DataFrame:
    """The edges with an end for those of `doomed` (source_id, target_id, relation) that were live."""
    key = ["source_id", "target_id", "relation"]
    both = edges.join(doomed.select(*key, F.lit(True).alias("_doomed")).distinct(), key, "left")
    return both.withColumn("expired_at", F.when(F.col("_doomed") & F.col("expired_at").isNull(), F.lit(at).cast("timestamp_ntz")).otherwise(F.col("expired_at"))).drop("_doomed")


def deepened(edges: DataFrame, schemas: DataFrame, rows: DataFrame, at: str) -> DataFrame:
    """New edges from schemas to their constituents (schema_id, id): only active schemas are deepened, and links that
    are there already aren't repeated."""
    good = schemas.join(rows.where("type = 'schema' AND status = 'active'").select(F.col("id").alias("schema_id")), "schema_id", "left_semi").distinct()
    there = edges.where("relation = 'derived_from'").select(F.col("source_id").alias("schema_id"), F.col("target_id").alias("id"))
    new = good.join(there, ["schema_id", "id"], "left_anti")
    return new.select(F.col("schema_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("derived_from").alias("relation"), F.lit(at).cast("timestamp_ntz").alias("created_at"))


def without_copies(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The rows but for those that repeat the keys of an earlier one: what batches of deletions come to, in one pass."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def table_counts(**tables: DataFrame) -> DataFrame:
    """table, n."""
    every = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        every = one if every is None else every.unionByName(one)
    return every

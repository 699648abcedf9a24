"""Decisions about candidates, rows to repair, things to read, and what a run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def authorised(candidates: DataFrame, rows: DataFrame, context: DataFrame) -> DataFrame:
    """run_id, position, unknown, inactive, foreign, allowed: whether all that a candidate cites exists, is active and
    was in its run's context (run_id, id)."""
    cited = candidates.select("run_id", "position", F.explode_outer("source_ids").alias("id"))
    known = cited.join(rows.select("id", "status"), "id", "left").join(context.select("run_id", "id", F.lit(True).alias("_given")).distinct(), ["run_id", "id"], "left")
    out = known.groupBy("run_id", "position").agg(
        F.count_if(F.col("id").isNotNull() & F.col("status").isNull()).alias("unknown"),
        F.count_if(F.col("status") != "active").alias("inactive"),
        F.count_if(F.col("id").isNotNull() & F.col("_given").isNull()).alias("foreign"),
        F.count("id").alias("cited"),
    )
    return out.withColumn("allowed", (F.col("cited") > 0) & (F.col("unknown") + F.col("inactive") + F.col("foreign") == 0))


def storage_decisions(accepted: DataFrame, same_sources: DataFrame, nearest: DataFrame, threshold: float = 0.85) -> DataFrame:
    """run_id, position, action, duplicate_of: what becomes of accepted candidates (run_id, position, operation).

    A CREATE is an exact duplicate if a stored discovery with the same set of sources is more similar than the
    threshold (of several the smallest id), else a semantic duplicate if its nearest active parent row is. Updates and
    supersessions are never duplicates. same_sources: (run_id, position, id, similarity), any number of each; nearest: (run_id,
    position, id, similarity) of the nearest row.
    """
    key = ["run_id", "position"]
    exact = same_sources.where(F.col("similarity") > threshold).groupBy(*key).agg(F.min("id").alias("_exact"))
    near = nearest.where(F.col("similarity") > threshold).groupBy(*key).agg(F.min_by("id", F.struct(-F.col("similarity"), "id")).alias("_near"))
    rows = accepted.join(exact, key, "left").join(near, key, "left")
    fresh = F.col("operation") == "CREATE"
    action = F.when(fresh & F.col("_exact").isNotNull(), "duplicate").when(fresh & F.col("_near").isNotNull(), "semantic_duplicate").otherwise(F.lower("operation"))
    return rows.select(*key, action.alias("action"), F.when(fresh, F.coalesce("_exact", "_near")).alias("duplicate_of"))


def rechunk_plan(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """parent_id, plan: complete if the stored pieces are the expected ones in order, leaf if one piece is enough and
    none is stored, clear if pieces stand where none belong, else needs. Both sides: (parent_id, chunk_index, hash)."""
    run = lambda df, name: df.groupBy("parent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "hash"))), lambda s: s["hash"]), ",").alias(name), F.count("*").alias(f"n_{name}"))
    both = run(expected, "want").join(run(stored, "have"), "parent_id", "full")
    plan = F.when(F.col("want").eqNullSafe(F.col("have")), "complete").when(F.col("want").isNull(), "clear").when((F.col("n_want") == 1) & F.col("have").isNull(), "leaf").otherwise("needs")
    return both.select("parent_id", plan.alias("plan"))


def references(packets: DataFrame) -> DataFrame:
    """run_id, ref, id: short names m1, m2, ... of a packet's rows in their order; each id is named once."""
    each = packets.select("run_id", F.posexplode(F.array_distinct("ids")).alias("n", "id"))
    return each.select("run_id", F.concat(F.lit("m"), (F.col("n") + 1).cast("string")).alias("ref"), "id")


def resolved(prose: DataFrame, refs: DataFrame) -> DataFrame:
    """run_id, position, text: bracketed names in prose replaced by the ids they stand for; unknown names stay."""
    names = refs.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("ref", F.col("id").cast("string").alias("id")))).alias("names"))
    joined = prose.join(names, "run_id", "left")
    parts = F.regexp_extract_all("text", F.lit(r"\[(m\d+)\]"), F.lit(1))
    text = F.aggregate(F.array_distinct(parts), F.col("text"), lambda t, ref: F.replace(t, F.concat(F.lit("["), ref, F.lit("]")), F.concat(F.lit("["), F.coalesce(F.try_element_at("names", ref), ref), F.lit("]"))))
    return joined.select("run_id", "position", text.alias("text"))


def contains_in_order(whole: Column, part: Column) -> Column:
    """Whether the part's elements stand in the whole in their order, other elements between them or not."""
    met = F.aggregate(whole, F.lit(0), lambda n, x: n + F.coalesce(F.try_element_at(part, n + 1) == x, F.lit(False)).cast("int"))
    return met == F.size(part)


def readable(urls: DataFrame, cooling: DataFrame, crowd: int = 2) -> DataFrame:
    """urls (url, host) that may be fetched: not cooling off themselves, nor of a host with `crowd` cooling addresses."""
    hosts = cooling.groupBy("host").agg(F.countDistinct("url").alias("n")).where(F.col("n") >= crowd).select("host")
    return urls.join(cooling.select("url").distinct(), "url", "left_anti").join(hosts, "host", "left_anti")


def systemic(outcomes: DataFrame) -> DataFrame:
    """day, reason: days on which nothing was tried although something waited, or all failed, three or more over two
    hosts or more. outcomes: (day, url, host, outcome ok / failed / waiting)."""
    sums = outcomes.groupBy("day").agg(F.count_if(F.col("outcome") == "ok").alias("ok"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.countDistinct(F.when(F.col("outcome") == "failed", F.col("host"))).alias("hosts"))
    reason = F.when((F.col("ok") == 0) & (F.col("failed") == 0), "nothing tried").when((F.col("ok") == 0) & (F.col("failed") >= 3) & (F.col("hosts") >= 2), "no page reached")
    return sums.select("day", reason.alias("reason")).where("reason IS NOT NULL")


def inventory_check(expected: DataFrame, found: DataFrame) -> DataFrame:
    """name, problem: missing, unexpected or changed, by (name, hash)."""
    both = expected.withColumnRenamed("hash", "_want").join(found.withColumnRenamed("hash", "_have"), "name", "full")
    problem = F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "unexpected").when(F.col("_want") != F.col("_have"), "changed")
    return both.select("name", problem.alias("problem")).where("problem IS NOT NULL")


def push(insights: DataFrame, pairs: DataFrame, run: DataFrame) -> DataFrame:
    """One row: whether the run gave a reason to notify at once, an insight across projects or a contradiction."""
    across = insights.join(run.select("run_id"), "run_id").where("cross_project").agg(F.count("*").alias("cross_project"))
    against = pairs.join(run.select("run_id"), "run_id").agg(F.count("*").alias("contradictions"))
    return across.join(against).withColumn("push", F.col("cross_project") + F.col("contradictions") > 0)


def validated(records: DataFrame, summary: int = 200) -> DataFrame:
    """id, error, coerced: records of JSON text checked as {summary, topics, novelty}; an over-long summary, more than
    five topics or a number that is text can be put right and count as coerced."""
    v = F.try_parse_json("json")
    text, novelty, topics = F.try_variant_get(v, "$.summary", "string"), F.try_variant_get(v, "$.novelty", "int"), F.try_variant_get(v, "$.topics", "array<string>")
    error = F.when(v.isNull(), "not json").when(F.coalesce(text, F.lit("")) == "", "no summary").when(novelty.isNull() | ~novelty.between(0, 3), "bad novelty")
    coerced = F.when(F.length(text) > summary, 1).otherwise(0) + F.when(F.size(topics) > 5, 1).otherwise(0) + F.when(F.try_variant_get(v, "$.novelty", "string").rlike(r"^\d+$") & (F.schema_of_variant(F.variant_get(v, "$.novelty", "variant")) == "STRING"), 1).otherwise(0)
    return records.select("id", error.alias("error"), F.when(error.isNull(), coerced).alias("coerced"))


def reopened(edges: DataFrame, used: DataFrame, since: str) -> DataFrame:
    """Edges whose expiry is taken back because either end was used since: (id, at) of uses."""
    fresh = used.where(F.col("at") >= F.lit(since).cast("timestamp_ntz")).select(F.col("id").alias("_used")).distinct()
    ends = edges.where("expired_at IS NOT NULL").withColumn("_end", F.explode(F.array_distinct(F.array("source_id", "target_id"))))
    return ends.join(fresh, F.col("_end") == F.col("_used"), "left_semi").drop("_end").distinct()


def superseded_below(rows: DataFrame, children: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows that an edge supersedes directly or through one of their children."""
    owner = children.select(F.col("id").alias("target_id"), F.col("parent_id").alias("_owner"))
    ids = edges.where("relation = 'supersedes'").join(owner, "target_id", "left").select(F.coalesce("_owner", "target_id").alias("id")).distinct()
    return rows.join(ids, "id", "left_semi")


def external_tags(rows: DataFrame, tags: DataFrame) -> DataFrame:
    """id, tags: the distinct trimmed tags of the outside item whose number ends the row's address."""
    number = F.try_element_at(F.split("url", "/"), F.lit(-1)).try_cast("bigint")
    clean = tags.select("item", F.trim("tag").alias("tag")).where("tag <> ''")
    return rows.select("id", number.alias("item")).join(clean, "item").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))

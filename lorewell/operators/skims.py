"""Skim records of rows, by model and prompt: what is missing, what a window holds, counts and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .capture import arrived, reason_key


def records(skims: DataFrame, ids: DataFrame, model: str, prompt: str) -> DataFrame:
    """The skims of the ids by one model and prompt."""
    return skims.where((F.col("model") == model) & (F.col("prompt_version") == prompt)).join(ids.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")


def missing(skims: DataFrame, ids: DataFrame, model: str, prompt: str) -> DataFrame:
    """position, id of the ids (position, id), each at its first place, that have no such skim."""
    done = skims.where((F.col("model") == model) & (F.col("prompt_version") == prompt)).select(F.col("memory_id").alias("id"))
    return ids.where("id IS NOT NULL").groupBy("id").agg(F.min("position").alias("position")).join(done, "id", "left_anti").select("position", "id")


def window(skims: DataFrame, rows: DataFrame, since: str, model: str, prompt: str, tag: str, flag: str, extra: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """id, title, source_type, created_at, cluster_id, truncated of skims of arrivals since a time, or among the `extra`
    ids of an earlier window, newest first."""
    own = skims.where((F.col("model") == model) & (F.col("prompt_version") == prompt))
    kept = rows.where(arrived(tag, flag))
    late = extra.select("id").distinct().withColumn("_extra", F.lit(True)) if extra is not None else None
    kept = kept.join(late, "id", "left") if late is not None else kept.withColumn("_extra", F.lit(None).cast("boolean"))
    kept = kept.where((F.col("created_at") >= F.lit(since).cast("timestamp_ntz")) | F.col("_extra"))
    found = own.join(kept, F.col("memory_id") == F.col("id")).select("id", "title", "source_type", "created_at", "cluster_id", "truncated").orderBy(F.desc("created_at"), "id")
    return found.limit(limit) if limit else found


def labelled(skims: DataFrame, labels: DataFrame, model: str, prompt: str) -> DataFrame:
    """The skims with the cluster labels (memory_id, cluster_id) of one model and prompt; a null label takes one away."""
    new = labels.select("memory_id", F.col("cluster_id").alias("_new"), F.lit(True).alias("_told"))
    told = F.col("_told") & (F.col("model") == model) & (F.col("prompt_version") == prompt)
    return skims.join(new, "memory_id", "left").withColumn("cluster_id", F.when(told, F.col("_new")).otherwise(F.col("cluster_id"))).select(*skims.columns)


def run_summary(skims: DataFrame) -> DataFrame:
    """run_id, records, truncated, input_tokens, output_tokens, cost of what each run paid for."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return skims.groupBy("run_id").agg(F.count("*").alias("records"), F.count_if("truncated").alias("truncated"), total("input_tokens"), total("output_tokens"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("cost"))


def probe(results: DataFrame) -> DataFrame:
    """Per channel: documents, calls, errors, valid and invalid ones, their percentages, coerced ones, fabricated quotes.

    results: (channel, dry_run, error, valid, coercions, quotes_emitted, quotes_verbatim). A dry run is no call; an error is
    neither valid nor invalid; percentages of nothing are null.
    """
    called = ~F.col("dry_run")
    failed, valid = called & F.col("error").isNotNull(), called & F.col("error").isNull() & F.col("valid")
    out = results.groupBy("channel").agg(
        F.count("*").alias("docs"), F.count_if(called).alias("calls"), F.count_if(failed).alias("errors"), F.count_if(valid).alias("valid"), F.count_if(called & F.col("error").isNull() & ~F.col("valid")).alias("invalid"),
        F.count_if(valid & (F.size("coercions") > 0)).alias("coerced"), F.sum(F.when(valid, F.col("quotes_emitted") - F.col("quotes_verbatim")).otherwise(0)).alias("fabricated"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.round(100.0 * F.col(a) / F.col(b), 1))
    return out.withColumns({"valid_pct": share("valid", "calls"), "coerced_pct": share("coerced", "valid")})


def reasons(results: DataFrame) -> DataFrame:
    """reason, n: invalid results by the class of what was wrong."""
    return results.where("NOT dry_run AND error IS NULL AND NOT valid").groupBy(reason_key(F.coalesce("validation_error", F.lit(""))).alias("reason")).agg(F.count("*").alias("n"))


def coercions(results: DataFrame) -> DataFrame:
    return results.where("NOT dry_run AND error IS NULL AND valid").select(F.explode("coercions").alias("coercion")).groupBy("coercion").agg(F.count("*").alias("n"))


def run_counters(results: DataFrame) -> DataFrame:
    """One row of a run's counters: documents by outcome, calls, tokens, cost, the slowest and the mean call."""
    each = {"candidates": F.count("*"), "skimmed": F.count_if("valid"), "failed": F.count_if(F.col("error").isNotNull()), "invalid": F.count_if(F.col("error").isNull() & ~F.col("valid")), "truncated": F.count_if("truncated"), "coerced": F.count_if(F.size("coercions") > 0)}
    sums = {c: F.coalesce(F.sum(c), F.lit(0)) for c in ("input_tokens", "output_tokens", "quotes_emitted", "quotes_verbatim")}
    rest = {"cost": F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6), "channels": F.countDistinct("channel"), "latency_mean": F.round(F.avg("latency"), 2), "latency_max": F.max("latency")}
    return results.agg(*[x.alias(c) for c, x in (each | sums | rest).items()])


def distilled_in_top(ranked: DataFrame, distilled: tuple[str, ...], channel: str, top: int = 5, decided: int = 3, prefix: int = 200) -> DataFrame:
    """category, queries, distilled_top, decision_top, near_duplicates of search results (category, query_id, rank, type,
    source_type, content): queries with a distilled type among the first `top`, with a row of the channel among the first
    `decided`, and with two results whose texts begin alike."""
    start = F.left(F.trim(F.regexp_replace(F.lower(F.coalesce("content", F.lit(""))), r"\s+", " ")), F.lit(prefix))
    each = ranked.withColumn("_start", start).groupBy("category", "query_id").agg(
        F.bool_or((F.col("rank") <= top) & F.col("type").isin(*distilled)).alias("d"), F.min(F.when(F.col("source_type") == channel, F.col("rank"))).alias("at"), (F.count("*") > F.countDistinct("_start")).alias("twice")
    )
    return each.groupBy("category").agg(F.count("*").alias("queries"), F.count_if("d").alias("distilled_top"), F.count_if(F.coalesce(F.col("at") <= decided, F.lit(False))).alias("decision_top"), F.count_if("twice").alias("near_duplicates"))


def found_with_company(ranked: DataFrame, expected: DataFrame, company: int = 5) -> DataFrame:
    """query_id, id, rank, score, others: where an expected row stands among a query's results, null where it doesn't, and
    the first `company` other results."""
    at = expected.join(ranked.select("query_id", "id", "rank", "score"), ["query_id", "id"], "left")
    near = ranked.where(F.col("rank") <= company + 1).select("query_id", F.col("id").alias("_other"), F.col("rank").alias("_rank"))
    both = at.join(near, (at.query_id == near.query_id) & (F.col("_other") != F.col("id")), "left").select(at["*"], "_other", "_rank")
    order = Window.partitionBy("query_id", "id").orderBy("_rank")
    kept = both.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= company)
    others = F.transform(F.array_sort(F.collect_list(F.when(F.col("_other").isNotNull(), F.struct("_rank", "_other")))), lambda s: s["_other"])
    return kept.groupBy("query_id", "id", "rank", "score").agg(others.alias("others"))


def known_expectations(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """query, expected_id, category, there of a query set: entries without a field or with a placeholder id are left out;
    those whose row is missing stay, marked."""
    good = entries.where(F.col("query").isNotNull() & F.col("expected_id").isNotNull() & F.col("category").isNotNull() & ~F.startswith("expected_id", F.lit("00000000")))
    return good.join(rows.select(F.col("id").cast("string").alias("expected_id"), F.lit(True).alias("_there")).distinct(), "expected_id", "left").select("query", "expected_id", "category", F.col("_there").isNotNull().alias("there"))


def trends(results: DataFrame) -> DataFrame:
    """file, date, corpus_size, total, mrr, delta of evaluation results (file, body as JSON) in the order of their names: a
    metric that isn't at the top is taken from the warm run's; delta is the change since the result before that has one."""
    of = lambda path: F.get_json_object("body", path)
    rows = results.select(
        "file", F.coalesce(of("$.metadata.timestamp"), F.lit("unknown")).alias("date"), of("$.metadata.corpus_size").cast("long").alias("corpus_size"), F.coalesce(of("$.summary.total"), of("$.summary.total_queries"), F.lit("0")).cast("long").alias("total"),
        F.coalesce(of("$.summary.mrr"), of("$.summary.warm.mrr")).cast("double").alias("mrr"),
    )
    return rows.withColumn("delta", F.round(F.col("mrr") - F.lag("mrr").over(Window.orderBy("file")), 6))

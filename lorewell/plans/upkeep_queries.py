"""Queries of skims, evaluation sets and maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as texts
from ..operators import corpus, maintenance, reports, skims
from . import corpus_queries, ledger_queries, views as v
from . import retrieval_queries as rq
from .capture_queries import ARRIVED, TRACKED, tracked
from .registry import query
from .views import AS_OF, CANDIDATES, CHUNKS, EDGES, MEMORIES, RUNS, read, with_views

SKIMS = """skims AS (SELECT doc_id AS memory_id, doc_id % 17 AS run_id, CASE doc_id % 3 WHEN 0 THEN 'large' ELSE 'small' END AS model, 'p' || (doc_id % 2) AS prompt_version, CASE WHEN doc_id % 4 = 0 THEN 'c' || (doc_id % 5) END AS cluster_id, doc_id % 5 = 0 AS truncated,
  CASE WHEN doc_id % 6 <> 0 THEN n_chars // 4 END AS input_tokens, doc_id % 300 AS output_tokens, CASE WHEN doc_id % 6 <> 0 THEN n_chars * 0.000001::DOUBLE END AS cost FROM documents)"""


def _skims(spark, d):
    i, n = F.col("doc_id"), F.col("n_chars")
    paid = i % 6 != 0
    return read(spark, d, "documents").select(
        i.alias("memory_id"), (i % 17).alias("run_id"), F.when(i % 3 == 0, "large").otherwise("small").alias("model"), F.concat(F.lit("p"), (i % 2).cast("string")).alias("prompt_version"), F.when(i % 4 == 0, F.concat(F.lit("c"), (i % 5).cast("string"))).alias("cluster_id"),
        (i % 5 == 0).alias("truncated"), F.when(paid, F.floor(n / 4)).alias("input_tokens"), (i % 300).alias("output_tokens"), F.when(paid, n * F.lit(0.000001)).alias("cost"),
    )


@query(with_views(SKIMS) + "SELECT memory_id, run_id, cluster_id FROM skims WHERE model = 'small' AND prompt_version = 'p1' AND memory_id IN (SELECT user_id FROM events)")
def skim_records(spark, d):
    return skims.records(_skims(spark, d), read(spark, d, "events").select(F.col("user_id").alias("id")), "small", "p1").select("memory_id", "run_id", "cluster_id")


@query(with_views(SKIMS) + "SELECT MIN(event_id) AS position, user_id AS id FROM events WHERE user_id NOT IN (SELECT memory_id FROM skims WHERE model = 'small' AND prompt_version = 'p1') GROUP BY user_id")
def missing_skims(spark, d):
    return skims.missing(_skims(spark, d), read(spark, d, "events").select(F.col("event_id").alias("position"), F.col("user_id").alias("id")), "small", "p1")


@query(
    with_views(MEMORIES, TRACKED, SKIMS)
    + f"SELECT id, title, source_type, created_at, cluster_id, truncated FROM skims JOIN tracked ON id = memory_id WHERE model = 'small' AND prompt_version = 'p0' AND (created_at >= TIMESTAMP '2024-01-20' OR id % 9 = 1) AND {ARRIVED}"
)
def window_skims(spark, d):
    rows = tracked(spark, d)
    return skims.window(_skims(spark, d), rows, "2024-01-20 00:00:00", "small", "p0", "own-synthesis", "own_synthesis", rows.where("id % 9 = 1").select("id"))


@query(with_views(SKIMS) + "SELECT memory_id, CASE WHEN memory_id % 7 = 0 AND model = 'small' AND prompt_version = 'p1' THEN CASE WHEN memory_id % 2 = 1 THEN 'c9' END ELSE cluster_id END AS cluster_id FROM skims")
def labelled_skims(spark, d):
    rows = _skims(spark, d)
    labels = rows.where("memory_id % 7 = 0").select("memory_id", F.when(F.col("memory_id") % 2 == 1, "c9").alias("cluster_id"))
    return skims.labelled(rows, labels, "small", "p1").select("memory_id", "cluster_id")


@query(with_views(SKIMS) + "SELECT run_id, COUNT(*) AS records, COUNT(*) FILTER (truncated) AS truncated, COALESCE(SUM(input_tokens), 0)::BIGINT AS input_tokens, COALESCE(SUM(output_tokens), 0)::BIGINT AS output_tokens, round(COALESCE(SUM(cost), 0), 6) AS cost FROM skims GROUP BY run_id")
def skim_summary(spark, d):
    return skims.run_summary(_skims(spark, d))


PROBES = """probes AS (SELECT source AS channel, doc_id % 13 = 0 AS dry_run, CASE WHEN doc_id % 11 = 0 THEN 'timeout' END AS error, doc_id % 5 <> 0 AS valid, CASE WHEN doc_id % 3 = 0 THEN ['enum'] WHEN doc_id % 7 = 0 THEN ['enum', 'list'] ELSE [] END AS coercions, doc_id % 4 AS quotes_emitted, (doc_id % 4) // 2 AS quotes_verbatim,
  'items[' || (doc_id % 9) || '] must be at most ' || (doc_id % 3) || ', got ' || doc_id AS validation_error, doc_id % 5 = 1 AS truncated, n_chars // 4 AS input_tokens, doc_id % 300 AS output_tokens, n_chars * 0.000001::DOUBLE AS cost, (doc_id % 90)::DOUBLE AS latency FROM documents)"""


def _probes(spark, d):
    i, n = F.col("doc_id"), F.col("n_chars")
    none = F.array().cast("array<string>")
    return read(spark, d, "documents").select(
        F.col("source").alias("channel"), (i % 13 == 0).alias("dry_run"), F.when(i % 11 == 0, "timeout").alias("error"), (i % 5 != 0).alias("valid"), F.when(i % 3 == 0, F.array(F.lit("enum"))).when(i % 7 == 0, F.array(F.lit("enum"), F.lit("list"))).otherwise(none).alias("coercions"),
        (i % 4).alias("quotes_emitted"), F.floor((i % 4) / 2).alias("quotes_verbatim"), F.concat(F.lit("items["), (i % 9).cast("string"), F.lit("] must be at most "), (i % 3).cast("string"), F.lit(", got "), i.cast("string")).alias("validation_error"),
        (i % 5 == 1).alias("truncated"), F.floor(n / 4).alias("input_tokens"), (i % 300).alias("output_tokens"), (n * F.lit(0.000001)).alias("cost"), (i % 90).cast("double").alias("latency"),
    )


@query(
    with_views(PROBES)
    + """, c AS (SELECT channel, COUNT(*) AS docs, COUNT(*) FILTER (NOT dry_run) AS calls, COUNT(*) FILTER (NOT dry_run AND error IS NOT NULL) AS errors, COUNT(*) FILTER (NOT dry_run AND error IS NULL AND valid) AS valid, COUNT(*) FILTER (NOT dry_run AND error IS NULL AND NOT valid) AS invalid,
  COUNT(*) FILTER (NOT dry_run AND error IS NULL AND valid AND len(coercions) > 0) AS coerced, COALESCE(SUM(quotes_emitted - quotes_verbatim) FILTER (NOT dry_run AND error IS NULL AND valid), 0)::BIGINT AS fabricated FROM probes GROUP BY 1)
SELECT *, CASE WHEN calls > 0 THEN round(100.0::DOUBLE * valid / calls, 1) END AS valid_pct, CASE WHEN valid > 0 THEN round(100.0::DOUBLE * coerced / valid, 1) END AS coerced_pct FROM c"""
)
def skim_probe(spark, d):
    return skims.probe(_probes(spark, d))


@query(
    with_views(PROBES)
    + """SELECT 'reason' AS kind, 'items[] must be at most N' AS name, COUNT(*) AS n FROM probes WHERE NOT dry_run AND error IS NULL AND NOT valid UNION ALL SELECT 'coercion', c, COUNT(*) FROM (SELECT unnest(coercions) AS c FROM probes WHERE NOT dry_run AND error IS NULL AND valid) GROUP BY 2"""
)
def probe_classes(spark, d):
    rows = _probes(spark, d)
    named = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("name"), "n")
    return named(skims.reasons(rows), "reason", "reason").unionByName(named(skims.coercions(rows), "coercion", "coercion"))


@query(
    with_views(PROBES)
    + """SELECT COUNT(*) AS candidates, COUNT(*) FILTER (valid) AS skimmed, COUNT(error) AS failed, COUNT(*) FILTER (error IS NULL AND NOT valid) AS invalid, COUNT(*) FILTER (truncated) AS truncated, COUNT(*) FILTER (len(coercions) > 0) AS coerced, SUM(input_tokens)::BIGINT AS input_tokens, SUM(output_tokens)::BIGINT AS output_tokens,
  SUM(quotes_emitted)::BIGINT AS quotes_emitted, SUM(quotes_verbatim)::BIGINT AS quotes_verbatim, round(SUM(cost), 6) AS cost, COUNT(DISTINCT channel) AS channels, round(AVG(latency), 2) AS latency_mean, MAX(latency) AS latency_max FROM probes"""
)
def skim_run_counters(spark, d):
    return skims.run_counters(_probes(spark, d))


@query(
    with_views(*rq.RANKED)
    + """, r AS (SELECT 'c' || (f.query_id % 3) AS category, f.query_id, f.final_rank AS rank, m.type, m.source_type, left(trim(regexp_replace(lower(m.content), '\\s+', ' ', 'g')), 200) AS start FROM final f JOIN rows m USING (id) WHERE final_rank <= 10),
e AS (SELECT category, query_id, bool_or(rank <= 5 AND type IN ('insight', 'decision')) AS d, MIN(rank) FILTER (source_type = 'src0') AS place, COUNT(*) > COUNT(DISTINCT start) AS twice FROM r GROUP BY 1, 2)
SELECT category, COUNT(*) AS queries, COUNT(*) FILTER (d) AS distilled_top, COUNT(*) FILTER (place <= 3) AS decision_top, COUNT(*) FILTER (twice) AS near_duplicates FROM e GROUP BY 1"""
)
def retrieval_probe(spark, d):
    found = rq._reranked(spark, d).where("final_rank <= 10").select("query_id", "id", F.col("final_rank").alias("rank"))
    wide = found.join(rq._rows(spark, d).select("id", "type", "source_type", "content"), "id").withColumn("category", F.concat(F.lit("c"), (F.col("query_id") % 3).cast("string")))
    return skims.distilled_in_top(wide, ("insight", "decision"), "src0")


@query(
    with_views(*rq.RANKED, rq.EXPECTED)
    + """, o AS (SELECT e.query_id, e.id, r.final_rank AS rank, r.rerank_score AS score FROM (SELECT DISTINCT query_id, id FROM expected) e LEFT JOIN final r USING (query_id, id)),
p AS (SELECT o.query_id, o.id, f.id AS other, f.final_rank AS place, ROW_NUMBER() OVER (PARTITION BY o.query_id, o.id ORDER BY f.final_rank) AS n FROM o JOIN final f ON f.query_id = o.query_id AND f.id <> o.id WHERE f.final_rank <= 6)
SELECT o.query_id, o.id, o.rank, o.score, COALESCE((SELECT string_agg(other::VARCHAR, ',' ORDER BY place) FROM p WHERE p.query_id = o.query_id AND p.id = o.id AND n <= 5), '') AS others FROM o"""
)
def golden_evaluation(spark, d):
    ranked = rq._reranked(spark, d).select("query_id", "id", F.col("final_rank").alias("rank"), F.col("rerank_score").alias("score"))
    found = skims.found_with_company(ranked, rq._expected(spark, d).select("query_id", "id").distinct())
    return found.withColumn("others", F.array_join(F.transform("others", lambda x: x.cast("string")), ","))


@query(
    with_views(CANDIDATES)
    + """, a AS (SELECT run_id, position, memory_id, unnest(['what is ' || strategy, 'why ' || position]) AS query FROM candidates WHERE memory_id IS NOT NULL AND (seat_a = 'accept')::INTEGER + (seat_b = 'accept')::INTEGER + (seat_c = 'accept')::INTEGER + (seat_d = 'accept')::INTEGER >= 3) SELECT query, memory_id::VARCHAR AS expected_id, 'golden' AS category, memory_id % 3 <> 0 AS there FROM a WHERE memory_id % 10 <> 0"""
)
def golden_queries(spark, d):
    from ..operators import ledger

    won = v.candidates(spark, d).where("memory_id IS NOT NULL").where(ledger.accepted())
    content = F.concat(F.lit("Body\nQuestions this answers:\n- what is "), "strategy", F.lit("\n- why "), F.col("position").cast("string"), F.lit("\n\nrest"))
    asked = won.select(F.col("memory_id"), F.explode(texts.golden_queries(content)).alias("query"))
    expected = F.when(F.col("memory_id") % 10 == 0, "00000000-0").otherwise(F.col("memory_id").cast("string"))
    entries = asked.select("query", expected.alias("expected_id"), F.lit("golden").alias("category"))
    return skims.known_expectations(entries, v.memories(spark, d).where("id % 3 <> 0"))


@query(
    """WITH r AS (SELECT 'golden_' || lpad(o_orderkey::VARCHAR, 9, '0') || '.json' AS file, CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date, o_custkey AS corpus_size, o_orderkey % 50 AS total, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 100) / 100.0::DOUBLE END AS mrr FROM orders WHERE o_orderpriority LIKE '1%')
SELECT *, round(mrr - LAG(mrr) OVER (ORDER BY file), 6) AS delta FROM r"""
)
def result_trends(spark, d):
    k = F.col("o_orderkey")
    mrr = F.when(k % 5 == 0, F.lit("{}")).when(k % 2 == 0, F.concat(F.lit('{"mrr": '), ((k % 100) / 100).cast("string"), F.lit("}"))).otherwise(F.concat(F.lit('{"warm": {"mrr": '), ((k % 100) / 100).cast("string"), F.lit("}}")))
    total = F.concat(F.lit(', "total'), F.when(k % 2 == 0, "").otherwise("_queries"), F.lit('": '), (k % 50).cast("string"), F.lit("}"))
    summary = F.concat(F.regexp_replace(F.when(mrr == "{}", '{"x": 0}').otherwise(mrr), r"\}$", ""), total)
    stamp = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit('"timestamp": "'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('", ')))
    body = F.concat(F.lit('{"metadata": {'), stamp, F.lit('"corpus_size": '), F.col("o_custkey").cast("string"), F.lit('}, "summary": '), summary, F.lit("}"))
    files = read(spark, d, "orders").where("o_orderpriority LIKE '1%'").select(F.concat(F.lit("golden_"), F.lpad(k.cast("string"), 9, "0"), F.lit(".json")).alias("file"), body.alias("body"))
    return skims.trends(files)


DEDUP = """d AS (SELECT id, FIRST_VALUE(id) OVER (PARTITION BY md5(content), project, status ORDER BY id) AS new_id FROM memories)"""


def _plan(spark, d):
    """Copies of documents by content, project and status, planned before some of them changed."""
    rows = corpus_queries._identified(spark, d).where("parent_id IS NULL").select("id", "parent_id", F.lit("source").alias("type"), F.lit("feed").alias("source_type"), F.lit("u").alias("url"), "project", "status", F.lit(None).cast("string").alias("record_kind"), F.lit(None).cast("int").alias("chunk_index"), "content", "created_at")
    from pyspark.sql import Window

    first = F.first("id").over(Window.partitionBy(F.md5(F.col("content").cast("binary")), "project", "status").orderBy("id"))
    plan = rows.select(F.col("id").alias("old_id"), first.alias("new_id"), maintenance.content_hash().alias("hash"), "status", maintenance.identity().alias("identity"), maintenance.identity().alias("keeper_identity")).where("old_id <> new_id")
    i = F.col("id")
    now = rows.where(i % 29 != 0).withColumns({"content": F.when(i % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")), "status": F.when(i % 11 == 0, "archived").otherwise(F.col("status")), "url": F.when(i % 13 == 0, "w").otherwise(F.col("url"))})
    done = plan.where("old_id % 5 = 0").select("old_id")
    return now, maintenance.verified_dedup(plan, now, done)


STATES = """s AS (SELECT id AS old_id, new_id, CASE WHEN id % 5 = 0 THEN 'done' WHEN id % 29 = 0 OR new_id % 29 = 0 THEN 'gone' WHEN id % 7 = 0 OR new_id % 7 = 0 THEN 'content' WHEN id % 11 = 0 OR new_id % 11 = 0 THEN 'status' WHEN id % 13 = 0 OR new_id % 13 = 0 THEN 'identity' ELSE 'apply' END AS state FROM d WHERE id <> new_id)"""


@query(with_views(MEMORIES, DEDUP, STATES) + "SELECT * FROM s")
def verified_dedup(spark, d):
    return _plan(spark, d)[1]


@query(with_views(MEMORIES, DEDUP, STATES) + "SELECT id, (SELECT COUNT(*) FROM s WHERE s.new_id = m.id AND state = 'apply') AS aliases FROM memories m WHERE id % 29 <> 0 AND id NOT IN (SELECT old_id FROM s WHERE state = 'apply')")
def applied_dedup(spark, d):
    rows, verified = _plan(spark, d)
    return maintenance.apply_dedup(verified, rows)[0].select("id", F.coalesce(F.size("aliases"), F.lit(0)).cast("long").alias("aliases")).withColumn("aliases", F.greatest("aliases", F.lit(0).cast("long")))


UUID_OF = "lower(lpad(to_hex({}), 8, '0')) || '-0000-4000-8000-000000000000'"


def _uuid(column):
    return F.concat(F.lpad(F.lower(F.hex(column)), 8, "0"), F.lit("-0000-4000-8000-000000000000"))


@query(
    with_views(CHUNKS)
    + f""", c AS (SELECT *, {UUID_OF.format('id')} AS uid FROM chunks), cited AS (SELECT {UUID_OF.format('user_id + 1000000000')} AS uid FROM events UNION SELECT {UUID_OF.format('l_partkey * 1000 + 1000000000')} FROM lineitem UNION SELECT {UUID_OF.format('o_custkey * 1000 + 1000000001')} FROM orders)
SELECT uid AS id FROM c WHERE uid IN (SELECT uid FROM cited)"""
)
def referenced_chunks(spark, d):
    ids = v.chunks(spark, d).select(_uuid(F.col("id")).alias("id"))
    column = read(spark, d, "events").select(F.upper(_uuid(F.col("user_id") + 1_000_000_000)).alias("id"))
    array = read(spark, d, "lineitem").select(F.array(_uuid(F.col("l_partkey") * 1000 + 1_000_000_000)).alias("ids"))
    prose = read(spark, d, "orders").select(F.concat(F.lit('{"see": "'), _uuid(F.col("o_custkey") * 1000 + 1_000_000_001), F.lit('."}')).alias("body"))
    return maintenance.referenced(ids, [column], [array], [prose])


@query(with_views(CHUNKS) + "SELECT parent_id, COUNT(*) FILTER (id % 3 <> 0) AS deleted, COUNT(*) FILTER (id % 3 = 0) AS retained FROM chunks WHERE status = 'superseded' GROUP BY 1")
def purged_chunks(spark, d):
    c = v.chunks(spark, d)
    return maintenance.purge(c, c.where("id % 3 = 0"))[1]


@query(
    with_views(MEMORIES, RUNS, CANDIDATES)
    + f""", c AS (SELECT run_id, COUNT(*) FILTER (seat_a = 'accept') AS accepted, COUNT(*) FILTER (seat_a = 'reject') AS rejected FROM candidates GROUP BY 1)
SELECT 'project' AS kind, id::VARCHAR AS key, upper({UUID_OF.format('id')}) AS project, NULL::BIGINT AS accepted, NULL::BIGINT AS rejected FROM memories WHERE id % 6 = 0
UNION ALL SELECT 'counters', run_id::VARCHAR, NULL, COALESCE(accepted, 0), COALESCE(rejected, 0) FROM runs LEFT JOIN c USING (run_id) WHERE COALESCE(accepted, 0) <> 1 OR COALESCE(rejected, 0) <> generated"""
)
def metadata_repairs(spark, d):
    rows = v.memories(spark, d).withColumn("project", F.when(F.col("id") % 6 == 0, F.upper(_uuid(F.col("id")))).otherwise(F.col("project")))
    runs = v.runs(spark, d).select("run_id", F.lit(1).alias("candidates_accepted"), F.col("generated").alias("candidates_rejected"))
    verdict = F.when(F.col("seat_a") == "accept", "ACCEPTED").when(F.col("seat_a") == "reject", "REJECTED")
    return maintenance.metadata_repairs(rows, runs, v.candidates(spark, d).select("run_id", verdict.alias("verdict")))


@query(with_views(MEMORIES) + "SELECT id, CASE WHEN id % 6 <> 0 OR id % 4 = 0 THEN CASE WHEN id % 6 = 0 THEN 'renamed' ELSE project END END AS project, CASE WHEN id % 6 = 0 AND id % 4 <> 0 THEN 'x' || id END AS legacy_project FROM memories")
def repaired_projects(spark, d):
    i = F.col("id")
    before = v.memories(spark, d).withColumn("project", F.when(i % 6 == 0, F.concat(F.lit("x"), i.cast("string"))).otherwise(F.col("project")))
    plan = before.where(i % 6 == 0).select(F.lit("project").alias("kind"), i.cast("string").alias("key"), "project")
    now = before.withColumn("project", F.when((i % 6 == 0) & (i % 4 == 0), "renamed").otherwise(F.col("project")))
    return maintenance.repaired_projects(now, plan).select("id", "project", "legacy_project")


@query(
    with_views(CHUNKS)
    + """SELECT parent_id, chunk_index, md5(content) AS hash, CASE WHEN parent_id % 3 = 0 THEN 'active' ELSE 'superseded' END AS status FROM chunks UNION ALL SELECT parent_id, chunk_index, md5(content || '!'), 'active' FROM chunks WHERE parent_id % 3 = 1"""
)
def applied_rechunk(spark, d):
    c = v.chunks(spark, d)
    plan = F.when(F.col("parent_id") % 3 == 0, "complete").when(F.col("parent_id") % 3 == 1, "needs").otherwise("clear")
    hashed = lambda x: c.select("parent_id", "chunk_index", F.md5(x.cast("binary")).alias("hash"))
    return maintenance.applied_rechunk(c.select("parent_id", plan.alias("plan")).distinct(), hashed(F.concat("content", F.lit("!"))), hashed(F.col("content")))


RETIRED = """marked AS (SELECT id, NULL::BIGINT AS parent_id, CASE WHEN id % 4 = 0 THEN 'superseded' ELSE 'active' END AS status, CASE WHEN id % 8 = 0 THEN 'gone' END AS retired_reason FROM memories UNION ALL SELECT id, parent_id, CASE WHEN parent_id % 4 = 0 THEN 'superseded' ELSE 'active' END, CASE WHEN parent_id % 8 = 0 THEN 'gone' END FROM chunks),
told AS (SELECT *, COALESCE(parent_id, id) % 3 AS a, COALESCE(parent_id, id) % 2 AS r FROM marked)"""


def _retired(spark, d):
    def marked(df, key):
        k = F.col(key)
        return df.withColumns({"status": F.when(k % 4 == 0, "superseded").otherwise("active"), "retired_reason": F.when(k % 8 == 0, "gone"), "retired_at": F.lit(None).cast("timestamp_ntz")})

    m = v.memories(spark, d)
    decisions = m.where("id % 3 <> 0").select("id", F.when(F.col("id") % 3 == 1, "retire").otherwise("restore").alias("action"), F.when(F.col("id") % 2 == 0, "relabelled").otherwise("below").alias("reason"))
    return marked(m, "id"), marked(v.chunks(spark, d), "parent_id"), decisions


@query(
    with_views(MEMORIES, CHUNKS, RETIRED)
    + """SELECT id, CASE WHEN a = 1 AND status = 'active' THEN 'superseded' WHEN a = 2 AND status = 'superseded' AND retired_reason IS NOT NULL THEN 'active' ELSE status END AS status, CASE WHEN a = 1 AND status = 'active' THEN CASE WHEN r = 0 THEN 'relabelled' ELSE 'below' END WHEN a = 2 AND status = 'superseded' AND retired_reason IS NOT NULL THEN NULL ELSE retired_reason END AS retired_reason FROM told"""
)
def retired_rows(spark, d):
    up, down = maintenance.retired(*_retired(spark, d), AS_OF)
    return up.select("id", "status", "retired_reason").unionByName(down.select("id", "status", "retired_reason"))


@query(with_views(MEMORIES) + "SELECT r AS reason, (SELECT COUNT(*) FROM memories WHERE id % 3 = 1 AND CASE WHEN id % 2 = 0 THEN 'relabelled' ELSE 'below' END = r) AS n FROM (VALUES ('relabelled'), ('below'), ('deleted')) v(r)")
def retirement_reasons(spark, d):
    return maintenance.reason_counts(_retired(spark, d)[2], ("relabelled", "below", "deleted"))


@query(f"SELECT l_orderkey AS run_id, l_linenumber AS position, CASE WHEN l_linenumber % 2 = 0 THEN {UUID_OF.format('l_partkey')} END AS target FROM lineitem")
def inserted_candidates(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("position"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" "), F.upper(_uuid(F.col("l_partkey"))))).otherwise("m12").alias("target"))
    return maintenance.inserted_candidates(rows)


@query(with_views(EDGES) + "SELECT source_id, target_id, relation, created_at, COALESCE(expired_at, CASE WHEN (source_id, target_id, relation) IN (SELECT source_id, target_id, relation FROM edges WHERE source_id % 7 = 0) THEN TIMESTAMP '2024-06-01' END) AS expired_at FROM edges")
def expired_edges(spark, d):
    e = v.edges(spark, d)
    return maintenance.expired(e, e.where("source_id % 7 = 0"), AS_OF).select("source_id", "target_id", "relation", "created_at", "expired_at")


@query(
    with_views(MEMORIES, EDGES)
    + """SELECT DISTINCT e.target_id AS source_id, e.source_id AS target_id, 'derived_from' AS relation FROM edges e JOIN memories m ON m.id = e.target_id AND m.type = 'schema' AND m.status = 'active' WHERE NOT EXISTS (SELECT 1 FROM edges x WHERE x.relation = 'derived_from' AND x.source_id = e.target_id AND x.target_id = e.source_id)"""
)
def deepened_schemas(spark, d):
    e = v.edges(spark, d)
    wanted = e.select(F.col("target_id").alias("schema_id"), F.col("source_id").alias("id"))
    return maintenance.deepened(e, wanted, v.memories(spark, d), AS_OF).drop("created_at")


@query("SELECT event_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def without_copies(spark, d):
    return maintenance.without_copies(read(spark, d, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("event_id")


@query(with_views(MEMORIES, EDGES) + 'SELECT \'rows\' AS "table", COUNT(*) AS n FROM memories UNION ALL SELECT \'edges\', COUNT(*) FROM edges UNION ALL SELECT \'runs\', COUNT(*) FROM orders')
def table_counts(spark, d):
    return maintenance.table_counts(rows=v.memories(spark, d), edges=v.edges(spark, d), runs=v.runs(spark, d))


@query(with_views(MEMORIES) + "SELECT type AS kind, COUNT(*) AS n FROM memories GROUP BY 1")
def item_counts(spark, d):
    """How many items a briefing has of each kind."""
    return v.memories(spark, d).groupBy(F.col("type").alias("kind")).agg(F.count("*").alias("n"))


@query(with_views(MEMORIES) + "SELECT id, title, type, source_type FROM memories WHERE created_at >= TIMESTAMP '2024-01-05' AND status IS DISTINCT FROM 'superseded' ORDER BY created_at DESC, id LIMIT 2000")
def recent_parents(spark, d):
    """The pool of the guaranteed slice: the newest 2,000 arrivals of a window."""
    rows = v.memories(spark, d).where(F.col("created_at") >= F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")).where(~F.col("status").eqNullSafe(F.lit("superseded")))
    return rows.orderBy(F.desc("created_at"), "id").limit(2000).select("id", "title", "type", "source_type")


@query(
    with_views(MEMORIES, CHUNKS)
    + """, r AS (SELECT id, NULL::BIGINT AS parent_id, title, source_type, project, status, created_at FROM memories UNION ALL SELECT c.id, c.parent_id, NULL, c.source_type, c.project, c.status, m.created_at FROM chunks c JOIN memories m ON m.id = c.parent_id),
f AS (SELECT * FROM r WHERE project = 'en' AND NOT (parent_id IS NOT NULL AND status = 'superseded') AND (parent_id IS NOT NULL OR id % 2 = 0))
SELECT id FROM f WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM f WHERE parent_id IS NULL) ORDER BY created_at DESC, id LIMIT 50"""
)
def listed_rows(spark, d):
    """A listing of fifty: chunks whose parent passes the same filters give way to it."""
    m = v.memories(spark, d)
    none = F.lit(None).cast("string")
    parents = m.select("id", F.lit(None).cast("long").alias("parent_id"), "title", "source_type", "project", "status", "created_at")
    pieces = v.chunks(spark, d).join(m.select(F.col("id").alias("parent_id"), "created_at"), "parent_id").select("id", "parent_id", none.alias("title"), "source_type", "project", "status", "created_at")
    rows = parents.unionByName(pieces).where("project = 'en'").where(corpus.not_history(F.col("parent_id"), F.col("status"))).where("parent_id IS NOT NULL OR id % 2 = 0")
    above = rows.where("parent_id IS NULL")
    return above.unionByName(corpus.collapse_chunks(rows.where("parent_id IS NOT NULL"), above)).orderBy(F.desc("created_at"), "id").limit(50).select("id")


@query(
    with_views(MEMORIES)
    + """, w AS (SELECT * FROM memories WHERE created_at >= TIMESTAMP '2024-01-03'), c AS (SELECT source_type, COUNT(*) AS n FROM w GROUP BY 1), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_type ORDER BY created_at DESC, id) AS rank FROM w) SELECT source_type, n, id, rank FROM k JOIN c USING (source_type) WHERE rank <= 3"""
)
def recent_activity(spark, d):
    rows = v.memories(spark, d).where(F.col("created_at") >= F.lit("2024-01-03 00:00:00").cast("timestamp_ntz"))
    counts = rows.groupBy("source_type").agg(F.count("*").alias("n"))
    return corpus.newest_per(rows, "source_type", 3).join(counts, "source_type").select("source_type", "n", "id", F.col("rank").cast("long").alias("rank"))


@query(
    with_views(MEMORIES, CHUNKS, EDGES)
    + """, a AS (SELECT id AS asked, id AS node FROM chunks WHERE id % 5 = 0 UNION SELECT id, parent_id FROM chunks WHERE id % 5 = 0), l AS (SELECT * FROM edges WHERE expired_at IS NULL),
e AS (SELECT asked, source_id, target_id, relation FROM a JOIN l ON l.source_id = node UNION SELECT asked, source_id, target_id, relation FROM a JOIN l ON l.target_id = node) SELECT * FROM e"""
)
def graph_of_chunks(spark, d):
    """A chunk's graph is its parent's and its own: each live edge once."""
    asked = v.chunks(spark, d).where("id % 5 = 0").select(F.col("id").alias("asked"), F.explode(F.array("id", "parent_id")).alias("node"))
    live = v.edges(spark, d).where("expired_at IS NULL").select("source_id", "target_id", "relation")
    ends = live.select(F.explode(F.array("source_id", "target_id")).alias("node"), "source_id", "target_id", "relation")
    return asked.join(ends, "node").select("asked", "source_id", "target_id", "relation").distinct()


@query(
    with_views(MEMORIES, CANDIDATES, ledger_queries.SLICES, ledger_queries.MEASURED)
    + """SELECT run_id, position, '- **' || CASE WHEN position % 3 = 0 THEN '(unnamed)' ELSE 'slice ' || position END || '**' || CASE WHEN position % 2 = 0 THEN ' [arrivals]' ELSE '' END || ' — ' || CASE WHEN position % 4 = 0 THEN '?' ELSE 'bridge' END || '; ' || resolved || '/' || requested || ' memories, arrivals ' || round_even(arrival_share * 100, 0)::BIGINT || '%, ' || source_types
  || ' source type(s) (' || dominant_source || ' ' || round_even(concentration * 100, 0)::BIGINT || '%), episodic ' || round_even(episodic_share * 100, 0)::BIGINT || '%, parents ' || distinct_parents || ', revisit ' || round_even(revisit_share * 100, 0)::BIGINT || '%' AS line FROM measured"""
)
def attention_lines(spark, d):
    k = F.col("position")
    rows = ledger_queries._measured(spark, d).withColumns({"name": F.when(k % 3 != 0, F.concat(F.lit("slice "), k.cast("string"))), "origin": F.when(k % 2 == 0, "arrivals").otherwise("explorer"), "strategy": F.when(k % 4 != 0, "bridge")})
    return reports.attention_lines(rows)


@query(
    """WITH r AS (SELECT doc_id AS id, source AS channel, doc_id % 3 AS d, doc_id % 2 AS q, doc_id % 5 = 0 AS c, doc_id % 4 AS p, doc_id % 7 AS u FROM documents)
SELECT id, id || ' | ' || channel || ' | S' || (id % 4) || ' N0 | ' || COALESCE(NULLIF(concat_ws(' ', CASE WHEN d > 0 THEN 'D' || d END, CASE WHEN q > 0 THEN 'Q' || q END, CASE WHEN c THEN 'C' END, CASE WHEN p > 0 THEN 'P' || p END, CASE WHEN u > 0 THEN '!' END), ''), '-') || ' | about ' || id || CASE WHEN id % 6 = 0 THEN ' [c' || (id % 5) || ']' ELSE '' END AS line FROM r"""
)
def skim_lines(spark, d):
    i = F.col("doc_id")
    rows = read(spark, d, "documents").select(
        i.alias("id"), F.col("source").alias("channel"), (i % 4).alias("salience"), F.lit(None).cast("int").alias("novelty"), (i % 3).alias("decisions"), (i % 2).alias("questions"), (i % 5 == 0).alias("contradiction"), (i % 4).alias("people"), (i % 7).alias("unverified"),
        F.concat(F.lit("about "), i.cast("string")).alias("summary"), F.when(i % 6 == 0, F.concat(F.lit("c"), (i % 5).cast("string"))).alias("cluster_id"),
    )
    return reports.inventory_lines(rows)


@query(with_views(MEMORIES) + "SELECT user_id % 5 AS run_id, id, title, type, CASE WHEN length(content) > 4000 THEN left(content, 4000) || ' …[truncated]' ELSE content END AS content FROM (SELECT DISTINCT user_id FROM events) e JOIN memories m ON m.id = e.user_id")
def packet_entries(spark, d):
    wanted = read(spark, d, "events").select((F.col("user_id") % 5).alias("run_id"), F.col("user_id").alias("id")).distinct()
    return reports.packet_entries(wanted, v.memories(spark, d))


@query(
    with_views(CANDIDATES)
    + """, r AS (SELECT DISTINCT run_id, position, strategy, reason FROM candidates WHERE reason IS NOT NULL), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY position, strategy) AS n FROM (SELECT run_id, position, strategy, MIN(reason) AS reason FROM r GROUP BY ALL)),
s AS (SELECT run_id, string_agg('- ' || strategy || ': It was ' || reason || '.', chr(10) ORDER BY n) AS section FROM k WHERE n <= 2 GROUP BY 1), t AS (SELECT *, SUM(length(section) + 1) OVER (ORDER BY run_id DESC ROWS UNBOUNDED PRECEDING) AS running FROM s) SELECT run_id, section FROM t WHERE running <= 3000"""
)
def lessons(spark, d):
    c = v.candidates(spark, d).where("reason IS NOT NULL").groupBy("run_id", "position", "strategy").agg(F.min("reason").alias("reason"))
    rows = c.withColumns({"at": F.col("run_id"), "reason": F.concat(F.lit("It was "), "reason", F.lit(". More was said. And more."))})
    return reports.lessons(rows, 2, 3000)


@query(
    with_views(MEMORIES)
    + """, i AS (SELECT id AS idx, title FROM memories WHERE id < 12), a AS (SELECT event_id AS position, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id % 20 END AS idx, CASE WHEN event_id % 2 = 0 THEN ' ' || event_type || ' ' END AS headline FROM events),
f AS (SELECT idx, MIN(position) AS position, arg_min(COALESCE(headline, ''), position) AS headline FROM a WHERE idx IS NOT NULL GROUP BY 1)
SELECT (ROW_NUMBER() OVER (ORDER BY f.position, idx))::INTEGER AS place, idx, left(trim(CASE WHEN headline = '' THEN title ELSE headline END), 120) AS headline FROM i JOIN f USING (idx) ORDER BY 1 LIMIT 5"""
)
def edited_briefing(spark, d):
    items = v.memories(spark, d).where("id < 12").select(F.col("id").alias("idx"), "title")
    e = F.col("event_id")
    answer = read(spark, d, "events").select(e.alias("position"), F.when(e % 3 != 0, F.col("user_id") % 20).alias("idx"), F.when(e % 2 == 0, F.concat(F.lit(" "), "event_type", F.lit(" "))).alias("headline"))
    return reports.edited(items, answer)


@query(
    """WITH b AS (SELECT conv_id AS task, 'v1|' || CASE WHEN conv_id % 2 = 0 THEN 'c' ELSE '' END || '|' || MAX(turn) AS key, MAX(turn) AS last FROM conversations GROUP BY conv_id), l AS (SELECT user_id AS task, 'v1||' || (event_id % 6) AS key, event_type = 'error' AS failed FROM events)
SELECT task, key, (SELECT COUNT(*) FROM l WHERE failed AND l.task = b.task AND l.key = b.key) AS count, (SELECT COUNT(*) FROM l WHERE failed AND l.task = b.task AND l.key = b.key) >= 3 AS abandoned FROM b"""
)
def batch_attempts(spark, d):
    batches = read(spark, d, "conversations").groupBy(F.col("conv_id").alias("task")).agg(F.max("turn").cast("string").alias("last_turn")).withColumns({"contract": F.lit("v1"), "cursor": F.when(F.col("task") % 2 == 0, "c")})
    log = read(spark, d, "events").select(F.col("user_id").alias("task"), F.concat(F.lit("v1||"), (F.col("event_id") % 6).cast("string")).alias("key"), (F.col("event_type") == "error").alias("failed"))
    return reports.attempts(log, batches)


@query(
    """SELECT 'v' || event_id AS id, CASE WHEN event_id % 4 = 1 THEN 'v' || event_id ELSE event_type END AS title, 'https://www.youtube.com/watch?v=v' || event_id AS url, CASE WHEN event_id % 2 = 0 THEN value END AS duration, CASE event_id % 3 WHEN 0 THEN 'c' || user_id WHEN 1 THEN 'u' || user_id ELSE '' END AS channel FROM events WHERE event_id % 7 NOT IN (0, 1, 2)"""
)
def playlist_entries(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    entry = F.to_json(
        F.struct(
            F.when(e % 7 != 1, F.concat(F.lit("v"), e.cast("string"))).alias("id"), F.when(e % 7 == 2, "[Private video]").when(e % 4 != 1, F.col("event_type")).alias("title"), F.when(e % 2 == 0, F.col("value")).alias("duration"),
            F.when(e % 3 == 0, F.concat(F.lit("c"), u.cast("string"))).alias("channel"), F.when(e % 3 == 1, F.concat(F.lit("u"), u.cast("string"))).alias("uploader"),
        )
    )
    return reports.playlist(read(spark, d, "events").select(F.when(e % 7 == 0, "{not json").otherwise(entry).alias("line")))


@query(
    """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), p AS (SELECT a.vec_id AS x, b.vec_id AS y, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) AS s FROM v a JOIN v b ON a.label = b.label WHERE a.vec_id % 20 = 0)
SELECT vec_id AS candidate_id, round(COALESCE((SELECT MAX(s) FROM p WHERE x = vec_id AND y % 20 <> 0), 0), 6) AS similarity FROM v WHERE vec_id % 20 = 0 AND label IS NOT NULL AND COALESCE((SELECT MAX(s) FROM p WHERE x = vec_id AND y % 20 <> 0), 0) < 0.5 AND NOT EXISTS (SELECT 1 FROM p WHERE x = vec_id AND y % 20 = 0 AND y < vec_id AND s >= 0.5)"""
)
def new_items(spark, d):
    e = read(spark, d, "embeddings").where("label IS NOT NULL").select(F.col("vec_id").alias("candidate_id"), "label", "embedding")
    found = reports.new_items(e.where("candidate_id % 20 = 0"), e.where("candidate_id % 20 <> 0"), "label", 0.5)
    return found.select("candidate_id", F.round("similarity", 6).alias("similarity"))


WORDS = ("running", "hopping", "skies", "generally", "relational", "knives", "the", "consistency", "happily", "of")


@query("SELECT event_id, CASE WHEN event_id % 10 IN (6, 9) THEN [] ELSE [['run', 'hop', 'sky', 'general', 'relat', 'knive', '', 'consist', 'happili', ''][event_id % 10 + 1]] END AS stems FROM events")
def stemmed_words(spark, d):
    from ..functions.stem import lexemes

    word = F.element_at(F.array(*[F.lit(w) for w in WORDS]), (F.col("event_id") % 10 + 1).cast("int"))
    return read(spark, d, "events").select("event_id", lexemes(F.array(word, F.lit("the"))).alias("stems"))

"""Queries of the decisions about candidates, repairs and readings, and of whole-corpus statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import briefing, curation, evaluation, graph, remap, retrieval, weights
from . import retrieval_queries as rq
from . import views as v
from .ledger_queries import LATER
from .registry import query
from .views import AS_OF, CANDIDATES, CHUNKS, EDGES, MEMORIES, RUNS, read, with_views

CONTEXT = "context AS (SELECT DISTINCT run_id, unnest(source_ids) AS id FROM candidates WHERE position % 2 = 1)"


@query(
    with_views(MEMORIES, CANDIDATES, CONTEXT)
    + """, k AS (SELECT c.run_id, c.position, c.id, m.status, x.id AS given FROM (SELECT run_id, position, unnest(source_ids) AS id FROM candidates) c LEFT JOIN memories m ON m.id = c.id LEFT JOIN context x ON x.run_id = c.run_id AND x.id = c.id)
SELECT run_id, position, COUNT(*) FILTER (status IS NULL) AS unknown, COUNT(*) FILTER (status <> 'active') AS inactive, COUNT(*) FILTER (given IS NULL) AS foreign, COUNT(id) AS cited, COUNT(*) FILTER (status IS NULL OR status <> 'active' OR given IS NULL) = 0 AS allowed FROM k GROUP BY 1, 2"""
)
def candidate_authorisation(spark, d):
    c = v.candidates(spark, d)
    context = c.where(F.pmod("position", F.lit(2)) == 1).select("run_id", F.explode("source_ids").alias("id"))
    return curation.authorised(c, v.memories(spark, d), context)


#: Candidates by run and position, which order lines repeat.
ONCE = "once AS (SELECT run_id, position, MIN(array_to_string(list_sort(source_ids), ',')) AS sources, MIN(memory_id) AS memory_id, MIN(score) AS score FROM candidates GROUP BY 1, 2)"


def _once(spark, d):
    sources = F.min(F.array_join(F.array_sort("source_ids"), ","))
    return v.candidates(spark, d).groupBy("run_id", "position").agg(F.split(sources, ",").alias("source_ids"), F.min("memory_id").alias("target_id"), F.min("score").alias("similarity"))


@query(
    with_views(CANDIDATES, ONCE)
    + """, o AS (SELECT *, CASE WHEN memory_id IS NULL THEN 'CREATE' WHEN memory_id % 2 = 0 THEN 'UPDATE' ELSE 'SUPERSEDE' END AS operation FROM once),
e AS (SELECT run_id, position, MIN(b.id) AS id FROM o JOIN (SELECT sources, run_id AS id, score * 10 AS similarity FROM once WHERE position = 1) b USING (sources) WHERE b.id < run_id AND similarity > 0.35 GROUP BY 1, 2)
SELECT o.run_id, o.position, CASE WHEN operation = 'CREATE' AND e.id IS NOT NULL THEN 'duplicate' WHEN operation = 'CREATE' AND score > 0.08 THEN 'semantic_duplicate' ELSE lower(operation) END AS action,
  CASE WHEN operation = 'CREATE' THEN COALESCE(e.id, CASE WHEN score > 0.08 THEN o.run_id % 7 END) END AS duplicate_of FROM o LEFT JOIN e USING (run_id, position)"""
)
def storage_decisions(spark, d):
    once = _once(spark, d).withColumn("sources", F.array_join("source_ids", ","))
    operation = F.when(F.col("target_id").isNull(), "CREATE").when(F.col("target_id") % 2 == 0, "UPDATE").otherwise("SUPERSEDE")
    stored = once.where("position = 1").select("sources", F.col("run_id").alias("id"), (F.col("similarity") * 10).alias("similarity"))
    same = once.select("run_id", "position", "sources").join(stored, "sources").where("id < run_id").withColumn("similarity", F.when(F.col("similarity") > 0.35, 0.9).otherwise(0.1))
    near = once.select("run_id", "position", (F.col("run_id") % 7).alias("id"), F.when(F.col("similarity") > 0.08, 0.9).otherwise(0.5).alias("similarity"))
    return curation.storage_decisions(once.withColumn("operation", operation), same, near)


@query(
    with_views(MEMORIES, CHUNKS)
    + """, w AS (SELECT parent_id, array_to_string(list(sha256(content) ORDER BY chunk_index), ',') AS want, COUNT(*) AS n FROM chunks GROUP BY 1),
h AS (SELECT parent_id, array_to_string(list(CASE WHEN parent_id % 5 = 0 THEN sha256(content || '!') ELSE sha256(content) END ORDER BY chunk_index), ',') AS have FROM (SELECT * FROM chunks WHERE parent_id % 3 <> 0 UNION ALL SELECT id, id, 0, content, source_type, project, status FROM memories WHERE id % 50 = 1 AND length(content) <= 4000) GROUP BY 1)
SELECT parent_id, CASE WHEN want IS NOT DISTINCT FROM have THEN 'complete' WHEN want IS NULL THEN 'clear' WHEN n = 1 AND have IS NULL THEN 'leaf' ELSE 'needs' END AS plan FROM w FULL JOIN h USING (parent_id)"""
)
def rechunk_plan(spark, d):
    c, m = v.chunks(spark, d), v.memories(spark, d)
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    want = c.select("parent_id", "chunk_index", sha(F.col("content")).alias("hash"))
    stray = m.where((F.pmod("id", F.lit(50)) == 1) & (F.length("content") <= v.CHUNK)).select(F.col("id").alias("parent_id"), F.lit(0).alias("chunk_index"), "content")
    kept = c.where(F.pmod("parent_id", F.lit(3)) != 0).select("parent_id", "chunk_index", "content").unionByName(stray)
    have = kept.select("parent_id", "chunk_index", sha(F.when(F.pmod("parent_id", F.lit(5)) == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))).alias("hash"))
    return curation.rechunk_plan(want, have)


@query(with_views(CANDIDATES, ONCE) + ", p AS (SELECT run_id, string_split(sources, ',') AS ids FROM once WHERE position = 1) SELECT run_id, 'm' || n AS ref, ids[n] AS id FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS n FROM p)")
def packet_references(spark, d):
    return curation.references(_once(spark, d).where("position = 1").select("run_id", F.col("source_ids").alias("ids")))


@query(with_views(CANDIDATES, ONCE) + "SELECT run_id, position, 'see [' || split_part(sources, ',', 1) || '] and [m9]' AS text FROM once WHERE position = 1")
def resolved_prose(spark, d):
    c = _once(spark, d).where("position = 1")
    refs = curation.references(c.select("run_id", F.col("source_ids").alias("ids")))
    return curation.resolved(c.select("run_id", "position", F.lit("see [m1] and [m9]").alias("text")), refs)


READINGS = """visits AS (SELECT DISTINCT 'h' || (user_id % 17) AS host, 'https://h' || (user_id % 17) || '/' || user_id AS url, event_type, ts::DATE AS day, user_id FROM events)"""


def _visits(spark, d):
    h = F.concat(F.lit("h"), F.pmod("user_id", F.lit(17)).cast("string"))
    url = F.concat(F.lit("https://"), h, F.lit("/"), F.col("user_id").cast("string"))
    return read(spark, d, "events").select(h.alias("host"), url.alias("url"), "event_type", F.col("ts").cast("date").alias("day"), "user_id").distinct()


@query(
    with_views(READINGS)
    + """, c AS (SELECT DISTINCT url, host FROM visits WHERE event_type = 'error' AND user_id % 4 = 0), h AS (SELECT host FROM c GROUP BY 1 HAVING COUNT(DISTINCT url) >= 2)
SELECT DISTINCT url, host FROM visits WHERE url NOT IN (SELECT url FROM c) AND host NOT IN (SELECT host FROM h)"""
)
def readable_addresses(spark, d):
    visits = _visits(spark, d)
    cooling = visits.where("event_type = 'error' AND user_id % 4 = 0").select("url", "host").distinct()
    return curation.readable(visits.select("url", "host").distinct(), cooling).select("url", "host")


@query(
    with_views(READINGS)
    + """, o AS (SELECT day, host, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' AND user_id % 9 = 0 AND day > DATE '2024-01-12' THEN 'ok' ELSE 'waiting' END AS outcome FROM visits),
s AS (SELECT day, COUNT(*) FILTER (outcome = 'ok') AS ok, COUNT(*) FILTER (outcome = 'failed') AS failed, COUNT(DISTINCT host) FILTER (outcome = 'failed') AS hosts FROM o GROUP BY 1)
SELECT day, reason FROM (SELECT day, CASE WHEN ok = 0 AND failed = 0 THEN 'nothing tried' WHEN ok = 0 AND failed >= 3 AND hosts >= 2 THEN 'no page reached' END AS reason FROM s) WHERE reason IS NOT NULL"""
)
def systemic_failures(spark, d):
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.expr("event_type = 'purchase' AND user_id % 9 = 0 AND day > DATE '2024-01-12'"), "ok").otherwise("waiting")
    return curation.systemic(_visits(spark, d).withColumn("outcome", outcome))


@query(
    """WITH w AS (SELECT doc_id AS name, md5(text) AS hash FROM documents WHERE doc_id % 11 <> 0), h AS (SELECT doc_id AS name, md5(CASE WHEN doc_id % 6 = 0 THEN text || '.' ELSE text END) AS hash FROM documents WHERE doc_id % 13 <> 0)
SELECT name, CASE WHEN h.hash IS NULL THEN 'missing' WHEN w.hash IS NULL THEN 'unexpected' ELSE 'changed' END AS problem FROM w FULL JOIN h USING (name) WHERE w.hash IS DISTINCT FROM h.hash"""
)
def inventory_check(spark, d):
    doc, i = read(spark, d, "documents"), F.col("doc_id")
    md5 = lambda t: F.md5(t.cast("binary")).alias("hash")
    want = doc.where(F.pmod(i, F.lit(11)) != 0).select(i.alias("name"), md5(F.col("text")))
    have = doc.where(F.pmod(i, F.lit(13)) != 0).select(i.alias("name"), md5(F.when(F.pmod(i, F.lit(6)) == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))))
    return curation.inventory_check(want, have)


@query(
    """WITH r AS (SELECT item_id AS id, CASE item_id % 5 WHEN 0 THEN '{broken' WHEN 1 THEN '{"summary": "", "novelty": 1}' WHEN 2 THEN '{"summary": "s", "novelty": 7}' WHEN 3 THEN '{"summary": "s", "novelty": "2", "topics": ["a","b","c","d","e","f"]}' ELSE '{"summary": "' || repeat('x', 250) || '", "novelty": 0}' END AS json FROM benchmark)
SELECT id, CASE id % 5 WHEN 0 THEN 'not json' WHEN 1 THEN 'no summary' WHEN 2 THEN 'bad novelty' END AS error, (CASE id % 5 WHEN 3 THEN 2 WHEN 4 THEN 1 END)::INTEGER AS coerced FROM r"""
)
def record_validation(spark, d):
    k = F.pmod("item_id", F.lit(5))
    json = (
        F.when(k == 0, "{broken").when(k == 1, '{"summary": "", "novelty": 1}').when(k == 2, '{"summary": "s", "novelty": 7}')
        .when(k == 3, '{"summary": "s", "novelty": "2", "topics": ["a","b","c","d","e","f"]}').otherwise(F.concat(F.lit('{"summary": "'), F.repeat(F.lit("x"), F.lit(250)), F.lit('", "novelty": 0}')))
    )
    return curation.validated(read(spark, d, "benchmark").select(F.col("item_id").alias("id"), json.alias("json")))


@query(
    with_views(EDGES)
    + """SELECT DISTINCT source_id, target_id, relation, created_at, expired_at, note FROM edges WHERE expired_at IS NOT NULL AND (source_id IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-25') OR target_id IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-25'))"""
)
def reopened_edges(spark, d):
    used = read(spark, d, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("at"))
    return curation.reopened(v.edges(spark, d), used, "2024-01-25")


@query(
    with_views(MEMORIES, CHUNKS, EDGES)
    + """, e AS (SELECT CASE WHEN target_id % 2 = 0 THEN 1000000000 + target_id * 1000 ELSE target_id END AS t FROM edges WHERE relation = 'supersedes')
SELECT id, title FROM memories WHERE id IN (SELECT t FROM e) OR id IN (SELECT parent_id FROM chunks WHERE id IN (SELECT t FROM e))"""
)
def superseded_below(spark, d):
    even = F.pmod("target_id", F.lit(2)) == 0
    e = v.edges(spark, d).withColumn("target_id", F.when(even, F.lit(1_000_000_000) + F.col("target_id") * 1000).otherwise(F.col("target_id")))
    return curation.superseded_below(v.memories(spark, d), v.chunks(spark, d), e).select("id", "title")


@query(with_views(MEMORIES) + "SELECT m.id, string_agg(DISTINCT e.event_type, ',' ORDER BY e.event_type) AS tags FROM memories m JOIN events e ON e.user_id = m.id GROUP BY m.id")
def external_tags(spark, d):
    tags = read(spark, d, "events").select(F.col("user_id").alias("item"), F.concat(F.lit(" "), "event_type").alias("tag"))
    return curation.external_tags(v.memories(spark, d), tags)


@query(
    with_views(EDGES)
    + """, m AS (SELECT source_id - source_id % 3 AS s0, target_id - target_id % 3 AS t0, * FROM edges),
o AS (SELECT CASE WHEN relation IN ('contradicts', 'relates_to') THEN LEAST(s0, t0) ELSE s0 END AS s, CASE WHEN relation IN ('contradicts', 'relates_to') THEN GREATEST(s0, t0) ELSE t0 END AS t, relation, created_at, expired_at FROM m)
SELECT s AS source_id, t AS target_id, relation, MIN(created_at) AS created_at, CASE WHEN NOT bool_or(expired_at IS NULL) THEN MAX(expired_at) END AS expired_at, COUNT(*) AS merged FROM o WHERE s <> t GROUP BY 1, 2, 3"""
)
def edge_remap(spark, d):
    ids = read(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") - F.pmod("doc_id", F.lit(3))).alias("survivor"))
    return graph.remap(v.edges(spark, d), ids).drop("note")


#: Each document's first equal one.
FIRSTS = "firsts AS (SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE MIN(doc_id) OVER (PARTITION BY text) END AS s FROM documents)"


def _merges(spark, d):
    """Equal texts: each document into the first of its source, these into the first of all."""
    named = F.sha2(F.concat(F.coalesce("source", F.lit("")), F.lit("\0"), "text").cast("binary"), 256)
    texts = read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("all"), named.alias("own"))
    own = texts.groupBy("own").agg(F.min("doc_id").alias("new_id"), F.first("all").alias("all"))
    everywhere = own.groupBy("all").agg(F.min("new_id").alias("first"))
    within = texts.select(F.col("doc_id").alias("old_id"), "own").join(own.select("own", "new_id"), "own").select("old_id", "new_id")
    across = own.select(F.col("new_id").alias("old_id"), "all").join(everywhere, "all").select("old_id", F.col("first").alias("new_id"))
    return within.where("old_id <> new_id").unionByName(across.where("old_id <> new_id"))


@query(
    with_views(CANDIDATES, FIRSTS)
    + """, c AS MATERIALIZED (SELECT row_number() OVER () AS n, * FROM candidates),
ids AS (SELECT n, list(COALESCE(s, x) ORDER BY i) AS source_ids FROM (SELECT n, unnest(list_sort(source_ids)) AS x, generate_subscripts(source_ids, 1) AS i FROM c) LEFT JOIN firsts ON doc_id = x GROUP BY n)
SELECT run_id, position, COALESCE(s, memory_id) AS memory_id, ids.source_ids, ids.source_ids[1] || ':' || ids.source_ids[-1] AS item_key FROM c JOIN ids USING (n) LEFT JOIN firsts ON doc_id = memory_id"""
)
def remapped_references(spark, d):
    key = F.concat_ws(remap.SEPARATOR, F.element_at("source_ids", 1).cast("string"), F.element_at("source_ids", -1).cast("string"))
    c = v.candidates(spark, d).withColumn("source_ids", F.array_sort("source_ids")).select("run_id", "position", "memory_id", "source_ids", key.alias("item_key"))
    return remap.moved(c, remap.survivors(_merges(spark, d)), ids=("memory_id",), arrays=("source_ids",), keys=("item_key",))


@query(
    with_views(MEMORIES, CANDIDATES, EDGES)
    + f""", live AS (SELECT DISTINCT source_id, target_id FROM edges WHERE relation = 'contradicts' AND (expired_at IS NULL OR expired_at > TIMESTAMP '{LATER}'))
SELECT 'contradiction' AS kind, COUNT(*) AS n FROM live JOIN memories a ON a.id = source_id AND a.status = 'active' JOIN memories b ON b.id = target_id AND b.status = 'active'
UNION ALL SELECT 'insight', COUNT(DISTINCT c.memory_id) FROM (SELECT memory_id, unnest(source_ids) AS id FROM candidates WHERE memory_id IS NOT NULL) c JOIN memories m ON m.id = c.id
UNION ALL SELECT 'resurfaced', LEAST(25, COUNT(*)) FROM memories WHERE status = 'active' AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY"""
)
def composed_briefing(spark, d):
    m = v.memories(spark, d)
    parts = {"contradiction": graph.pairs(v.edges(spark, d), m, "contradicts", LATER), "insight": briefing.insights(v.candidates(spark, d), m), "resurfaced": briefing.resurfaced(m, AS_OF, 90, 25)}
    kinds = [rows.select(F.lit(kind).alias("kind")) for kind, rows in parts.items()]
    counted = [k.groupBy("kind").agg(F.count("*").alias("n")) for k in kinds]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query(with_views(MEMORIES) + f"SELECT COUNT(*) AS n, MIN(created_at) AS first_at, MAX(created_at) AS last_at, COUNT(*) FILTER (created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 120 DAY) AS recent, COUNT(DISTINCT project) AS projects FROM memories WHERE status <> 'superseded'")
def corpus_statistics(spark, d):
    recent = F.col("created_at") >= F.lit(AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 120 DAYS")
    return v.memories(spark, d).where("status <> 'superseded'").agg(F.count("*").alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.count_if(recent).alias("recent"), F.countDistinct("project").alias("projects"))


@query(with_views(MEMORIES) + "SELECT source_type, bool_or(type = 'decision') AS decides, bool_or(access_count = 0) AS unused, bool_or(length(content) > 20000) AS long FROM memories GROUP BY 1")
def predicate_matrix(spark, d):
    return v.memories(spark, d).groupBy("source_type").agg(F.bool_or(F.col("type") == "decision").alias("decides"), F.bool_or(F.col("access_count") == 0).alias("unused"), F.bool_or(F.length("content") > 20000).alias("long"))


@query(with_views(RUNS) + "SELECT run_id, run_type, round(cost - LAG(cost) OVER (PARTITION BY run_type ORDER BY started_at, run_id), 2) AS change FROM runs WHERE completed_at IS NOT NULL")
def cost_trend(spark, d):
    before = F.lag("cost").over(Window.partitionBy("run_type").orderBy("started_at", "run_id"))
    return v.runs(spark, d).where("completed_at IS NOT NULL").select("run_id", "run_type", F.round(F.col("cost") - before, 2).alias("change"))


@query(with_views(RUNS, CANDIDATES) + "SELECT r.run_id, r.generated AS stated, COUNT(c.run_id) AS counted FROM runs r LEFT JOIN candidates c ON c.run_id = r.run_id GROUP BY 1, 2 HAVING r.generated <> COUNT(c.run_id)")
def counter_reconciliation(spark, d):
    counted = v.candidates(spark, d).groupBy("run_id").agg(F.count("*").alias("counted"))
    joined = v.runs(spark, d).join(counted, "run_id", "left").select("run_id", F.col("generated").alias("stated"), F.coalesce("counted", F.lit(0)).alias("counted"))
    return joined.where("stated <> counted")


@query(
    with_views(RUNS, CANDIDATES)
    + "SELECT run_id, run_type FROM runs r WHERE run_id IN (SELECT run_id FROM candidates) AND run_id NOT IN (SELECT run_id FROM candidates WHERE position = 3)"
)
def runs_to_backfill(spark, d):
    c = v.candidates(spark, d)
    return v.runs(spark, d).join(c, "run_id", "left_semi").join(c.where("position = 3"), "run_id", "left_anti").select("run_id", "run_type")


@query(
    with_views(*rq.RANKED)
    + """SELECT query_id, id FROM (SELECT f.query_id, f.id, ROW_NUMBER() OVER (PARTITION BY f.query_id ORDER BY f.final_rank) AS n FROM final f JOIN rows m ON m.id = f.id WHERE f.id <> f.query_id AND m.type = 'decision') WHERE n = 1"""
)
def prior_decisions(spark, d):
    ranked = rq._reranked(spark, d).where("type = 'decision' AND id <> query_id")
    return ranked.groupBy("query_id").agg(F.min_by("id", "final_rank").alias("id"))


SETS = (("plain", 0.45, 0.2), ("words", 0.1, 0.6), ("ranks", 0.8, 0.0), ("none", 0.0, 0.0))


@query(
    with_views(*rq.RANKED, rq.EXPECTED)
    + f""", w(name, a, b) AS (VALUES {', '.join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE)" for n, a, b in SETS)}),
s AS (SELECT name, query_id, id, ROW_NUMBER() OVER (PARTITION BY name, query_id ORDER BY round((normalised * a + overlap * b + title_overlap * 0.18 + context_overlap * 0.10 + recency * 0.12 + len_score * 0.08 + depth * 0.05 + reinforcement + boost + penalty)::DOUBLE, 6) DESC, id) AS rank FROM signals, w),
h AS (SELECT name, query_id, MIN(rank) AS rank FROM s WHERE (query_id, id) IN (SELECT query_id, id FROM expected) GROUP BY 1, 2)
SELECT name, round(SUM(1.0::DOUBLE / rank) / (SELECT COUNT(DISTINCT query_id) FROM expected), 6) AS mrr FROM h GROUP BY name"""
)
def weight_search(spark, d):
    sets = spark.createDataFrame(list(SETS), "name string, w_rrf double, w_overlap double")
    signals = retrieval.signals(rq._pool(spark, d), rq._rows(spark, d), rq._asked(spark, d), AS_OF, rq._index(spark, d))
    return evaluation.search(signals, sets, rq._expected(spark, d), retrieval.score({"rrf": F.col("w_rrf"), "overlap": F.col("w_overlap")}))


@query()
def weight_optimum(spark, d):
    """name, kind, before, after, mrr_before, mrr_after, measured: weights that find the benchmark's passages best;
    tests hold it against the stated sets and a plain ranking."""
    signals = retrieval.signals(rq._pool(spark, d), rq._rows(spark, d), rq._asked(spark, d), AS_OF, rq._index(spark, d))
    return weights.optimise(signals, rq._expected(spark, d), [{"rrf": a, "overlap": b} for _, a, b in SETS])


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'verbatim_exact' END AS found, COUNT(*) AS n FROM documents WHERE regexp_matches(text, '[A-Za-z]{3,} [A-Za-z]{3,}') GROUP BY 1")
def faithfulness_counts(spark, d):
    pair = F.regexp_extract("text", r"([A-Za-z]{3,} [A-Za-z]{3,})", 1)
    quote = F.when(F.pmod("doc_id", F.lit(2)) == 0, pair).otherwise(F.concat(pair, F.lit(" never said this")))
    rows = read(spark, d, "documents").where(pair != "").select(text.match_quote(quote, F.col("text")).alias("found"))
    return rows.groupBy("found").agg(F.count("*").alias("n"))


@query()
def subsequence_turns(spark, d):
    """conv_id, contained: whether a conversation's questions, in every second one backwards, stand in its turns in order;
    tests hold it against a plain loop."""
    ordered = lambda rows: F.transform(F.array_sort(F.collect_list(rows)), lambda s: s["text"])
    turns = read(spark, d, "conversations").groupBy("conv_id").agg(ordered(F.struct("turn", "text")).alias("whole"), ordered(F.when(F.col("role") == "user", F.struct("turn", "text"))).alias("part"))
    turns = turns.withColumn("part", F.when(F.col("conv_id") % 2 == 1, F.reverse("part")).otherwise(F.col("part")))
    return turns.select("conv_id", curation.contains_in_order(F.col("whole"), F.col("part")).alias("contained"))

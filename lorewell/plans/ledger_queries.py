"""Queries over edges, runs, candidates, slices, briefings and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import briefing, graph, ledger, store
from . import views as v
from .registry import query
from .views import AS_OF, CANDIDATES, CHUNKS, EDGES, MEMORIES, RUNS, read, with_views

#: Orders are of the nineties; edges are judged by a day after all of them.
LATER = "1998-06-01 00:00:00"
LIVE = f"live AS (SELECT * FROM edges WHERE expired_at IS NULL OR expired_at > TIMESTAMP '{LATER}')"
ORIENTED = """oriented AS (SELECT CASE WHEN relation IN ('contradicts', 'relates_to') THEN LEAST(source_id, target_id) ELSE source_id END AS s, CASE WHEN relation IN ('contradicts', 'relates_to') THEN GREATEST(source_id, target_id) ELSE target_id END AS t,
  relation, note, created_at, expired_at FROM edges)"""


@query(
    with_views(MEMORIES, EDGES, LIVE)
    + """, b AS (SELECT source_id AS id, target_id AS other, 'out' AS way, * FROM live UNION ALL SELECT target_id, source_id, 'in', * FROM live),
n AS (SELECT *, CASE WHEN relation IN ('contradicts', 'relates_to') THEN 'both' ELSE way END AS direction FROM b),
o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id, other, relation, direction ORDER BY expired_at NULLS FIRST, created_at DESC, source_id, target_id) AS k FROM n)
SELECT o.id, o.other, o.relation, o.direction, o.created_at, o.expired_at, m.title, m.status FROM o JOIN memories m ON m.id = o.other WHERE k = 1"""
)
def live_neighbours(spark, d):
    return graph.neighbours(v.edges(spark, d), v.memories(spark, d), LATER).drop("note")


@query(
    with_views(MEMORIES, EDGES)
    + """, b AS (SELECT source_id AS id, target_id AS other, 'out' AS way, * FROM edges UNION ALL SELECT target_id, source_id, 'in', * FROM edges),
n AS (SELECT *, CASE WHEN relation IN ('contradicts', 'relates_to') THEN 'both' ELSE way END AS direction FROM b),
o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id, other, relation, direction ORDER BY expired_at NULLS FIRST, created_at DESC, source_id, target_id) AS k FROM n)
SELECT o.id, o.other, o.relation, o.direction, o.created_at, o.expired_at, m.title FROM o JOIN memories m ON m.id = o.other WHERE k = 1"""
)
def all_neighbours(spark, d):
    return graph.neighbours(v.edges(spark, d), v.memories(spark, d), LATER, include_expired=True).drop("note", "status")


@query(
    with_views(EDGES, LIVE)
    + f"""SELECT source_id, target_id, relation, created_at FROM live WHERE created_at < TIMESTAMP '{LATER}' - INTERVAL 90 DAY AND relation NOT IN ('derived_from', 'schema_contains')
  AND source_id NOT IN (SELECT user_id FROM events) AND target_id NOT IN (SELECT user_id FROM events)"""
)
def stale_edges(spark, d):
    used = read(spark, d, "events").select(F.col("user_id").alias("id"))
    return graph.stale(v.edges(spark, d), used, LATER).select("source_id", "target_id", "relation", "created_at")


@query(
    with_views(EDGES, ORIENTED)
    + """SELECT s AS source_id, t AS target_id, relation, MIN(created_at) AS created_at, CASE WHEN NOT bool_or(expired_at IS NULL) THEN MAX(expired_at) END AS expired_at,
  string_agg(note, chr(10) ORDER BY created_at, note) AS note, COUNT(*) AS merged FROM oriented WHERE s <> t GROUP BY s, t, relation"""
)
def edge_merge(spark, d):
    return graph.merge(v.edges(spark, d))


@query(
    with_views(EDGES, ORIENTED)
    + """, x AS (SELECT s, t, relation, note, created_at, CASE WHEN created_at < TIMESTAMP '1996-01-01' THEN expired_at END AS expired_at, CASE WHEN created_at < TIMESTAMP '1996-01-01' THEN 0 ELSE 1 END AS turn FROM oriented)
SELECT s AS source_id, t AS target_id, relation, arg_max(note, (turn, created_at, note)) FILTER (note IS NOT NULL) AS note, MIN(created_at) AS created_at,
  CASE WHEN MAX(turn) = 0 AND NOT bool_or(expired_at IS NULL) THEN MAX(expired_at) END AS expired_at FROM x GROUP BY s, t, relation"""
)
def edge_upsert(spark, d):
    e = v.edges(spark, d)
    old = F.col("created_at") < F.lit("1996-01-01").cast("timestamp_ntz")
    return graph.upsert(e.where(old), e.where(~old))


@query(
    with_views(MEMORIES, EDGES, LIVE)
    + """SELECT e.a, e.b, x.title AS title_a, y.title AS title_b, e.created_at FROM (SELECT source_id AS a, target_id AS b, MAX(created_at) AS created_at FROM live WHERE relation = 'contradicts' GROUP BY 1, 2) e
JOIN memories x ON x.id = e.a AND x.status = 'active' JOIN memories y ON y.id = e.b AND y.status = 'active'"""
)
def contradictions(spark, d):
    return graph.pairs(v.edges(spark, d), v.memories(spark, d), "contradicts", LATER)


@query(
    with_views(MEMORIES, EDGES, LIVE)
    + """SELECT id, member, rank FROM (SELECT e.source_id AS id, e.target_id AS member, (ROW_NUMBER() OVER (PARTITION BY e.source_id ORDER BY m.created_at DESC, e.target_id))::INTEGER AS rank
  FROM (SELECT DISTINCT source_id, target_id FROM live WHERE relation = 'schema_contains') e JOIN memories m ON m.id = e.target_id) WHERE rank <= 3"""
)
def constituents(spark, d):
    return graph.constituents(v.edges(spark, d), v.memories(spark, d), "schema_contains", 3, LATER)


@query(with_views(MEMORIES, EDGES) + "SELECT id, title, status FROM memories WHERE id IN (SELECT target_id FROM edges WHERE relation = 'supersedes')")
def superseded_rows(spark, d):
    return graph.superseded(v.memories(spark, d), v.edges(spark, d)).select("id", "title", "status")


@query(
    with_views(MEMORIES)
    + """SELECT id, other, gap, rank FROM (SELECT a.id, b.id AS other, abs(epoch(a.created_at) - epoch(b.created_at))::BIGINT AS gap,
  (ROW_NUMBER() OVER (PARTITION BY a.id ORDER BY abs(epoch(a.created_at) - epoch(b.created_at)), b.id))::INTEGER AS rank
  FROM memories a JOIN memories b ON a.source_type = b.source_type AND a.id <> b.id AND abs(epoch(a.created_at) - epoch(b.created_at)) <= 86400) WHERE rank <= 3"""
)
def temporal_neighbours(spark, d):
    return graph.within_a_day(v.memories(spark, d), 3)


@query(with_views(EDGES, CANDIDATES) + "SELECT unnest(source_ids) AS id FROM candidates UNION SELECT source_id FROM edges UNION SELECT target_id FROM edges")
def cited_ids(spark, d):
    return store.cited_ids(v.candidates(spark, d), v.edges(spark, d))


LATEST = "latest AS (SELECT * FROM runs WHERE completed_at IS NOT NULL ORDER BY started_at DESC, run_id DESC LIMIT 50)"
OWN = "own AS (SELECT c.*, l.started_at, (seat_a = 'accept')::INTEGER + (seat_b = 'accept')::INTEGER + (seat_c = 'accept')::INTEGER + (seat_d = 'accept')::INTEGER AS votes FROM candidates c JOIN latest l USING (run_id))"


@query(with_views(RUNS, CANDIDATES, LATEST, OWN) + "SELECT run_id, position, strategy, reason, user_rejected_at FROM own WHERE user_rejected_at IS NOT NULL")
def recent_rejections(spark, d):
    return ledger.user_rejections(v.candidates(spark, d), v.runs(spark, d), 50)


@query(
    with_views(RUNS, CANDIDATES, LATEST, OWN)
    + """SELECT run_id, position, strategy, against FROM (SELECT *, concat_ws(',', CASE WHEN seat_a = 'reject' THEN 'seat_a' END, CASE WHEN seat_b = 'reject' THEN 'seat_b' END, CASE WHEN seat_c = 'reject' THEN 'seat_c' END, CASE WHEN seat_d = 'reject' THEN 'seat_d' END) AS against
  FROM own WHERE votes >= 3) WHERE against <> ''"""
)
def accepted_dissents(spark, d):
    return ledger.accepted_dissents(v.candidates(spark, d), v.runs(spark, d), 50)


@query(
    with_views(RUNS, CANDIDATES, LATEST, OWN)
    + """, e AS (SELECT run_id, started_at, COUNT(*) AS n, COUNT(*) FILTER (votes >= 3) AS a FROM own GROUP BY 1, 2),
r AS (SELECT COUNT(*) AS runs, SUM(1 + GREATEST(1, ceil(n / 2)) + 4 * n)::BIGINT AS calls FROM e)
SELECT COUNT(*) AS generated, COUNT(*) FILTER (votes >= 3) AS accepted, round(COUNT(*) FILTER (votes >= 3 AND 'reject' IN (seat_a, seat_b, seat_c, seat_d)) / COUNT(*) FILTER (votes >= 3), 6) AS split_share, COUNT(DISTINCT strategy) AS strategies,
  round(COUNT(*) FILTER (votes >= 3) / COUNT(*), 6) AS acceptance, round(COUNT(*) FILTER (votes >= 3) / MAX(r.calls), 6) AS cost_efficiency, MAX(r.runs) AS runs, MAX(r.calls) AS calls FROM own, r"""
)
def tier1_metrics(spark, d):
    return ledger.process_metrics(v.candidates(spark, d), v.runs(spark, d), 50).drop("trend")


@query(
    with_views(MEMORIES, CANDIDATES, "kids AS (SELECT doc_id AS parent_id, SUM(n_chars % 7)::BIGINT AS below FROM documents GROUP BY 1)")
    + """SELECT strategy, COUNT(*) AS created, COUNT(user_rejected_at) AS rejected, round(avg(access_count + COALESCE(below, 0)), 6) AS mean_access
FROM candidates c JOIN memories m ON m.id = c.memory_id LEFT JOIN kids k ON k.parent_id = m.id WHERE memory_id IS NOT NULL GROUP BY strategy"""
)
def tier2_metrics(spark, d):
    kids = read(spark, d, "documents").select(F.col("doc_id").alias("parent_id"), F.pmod("n_chars", F.lit(7)).alias("access_count"))
    return ledger.engagement(v.candidates(spark, d), v.memories(spark, d), kids)


@query(
    with_views(CANDIDATES)
    + """, c AS (SELECT strategy, COUNT(*) AS tried, COUNT(*) FILTER ((seat_a = 'accept')::INTEGER + (seat_b = 'accept')::INTEGER + (seat_c = 'accept')::INTEGER + (seat_d = 'accept')::INTEGER >= 3) AS accepted FROM candidates GROUP BY 1)
SELECT strategy, tried, accepted, round(1.5 * sqrt(ln(SUM(tried) OVER ()) / tried), 6) AS bonus FROM c UNION ALL SELECT 'analogy', 0, 0, 'infinity'::DOUBLE"""
)
def strategy_ucb1(spark, d):
    c = v.candidates(spark, d)
    known = c.select("strategy").unionByName(spark.createDataFrame([("analogy",)], "strategy string"))
    return ledger.strategy_bonus(c, known)


@query(
    with_views(CANDIDATES)
    + """, s AS (SELECT score, (seat_a = 'accept')::INTEGER + (seat_b = 'accept')::INTEGER + (seat_c = 'accept')::INTEGER + (seat_d = 'accept')::INTEGER = 2 AS lone, unnest(['seat_a', 'seat_b', 'seat_c', 'seat_d']) AS seat, unnest([seat_a, seat_b, seat_c, seat_d]) AS verdict FROM candidates)
SELECT seat, COUNT(*) FILTER (verdict = 'accept') AS accept, COUNT(*) FILTER (verdict = 'reject') AS reject, COUNT(*) FILTER (verdict = 'revise') AS revise, round(avg(score), 6) AS mean_score, COUNT(*) FILTER (verdict = 'reject' AND lone) AS blocking FROM s GROUP BY seat"""
)
def panel_matrix(spark, d):
    return ledger.panel_matrix(v.candidates(spark, d))


@query(with_views(CANDIDATES) + "SELECT run_id, position, unnest(['seat_a', 'seat_b', 'seat_c', 'seat_d']) AS seat, unnest([seat_a, seat_b, seat_c, seat_d]) AS verdict FROM candidates")
def verdicts_by_seat(spark, d):
    return ledger.verdicts_long(v.candidates(spark, d))


@query(
    with_views(RUNS)
    + """SELECT run_id, run_type, LAST_VALUE(CASE WHEN completed_at IS NOT NULL THEN run_id END IGNORE NULLS) OVER (PARTITION BY run_type ORDER BY started_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM runs"""
)
def previous_run(spark, d):
    return ledger.previous_run(v.runs(spark, d))


@query(
    with_views(RUNS)
    + """, l AS (SELECT *, LAST_VALUE(completed_at IGNORE NULLS) OVER (PARTITION BY run_type ORDER BY started_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM runs)
SELECT run_id, run_type, CASE WHEN last IS NULL THEN started_at - INTERVAL 7 DAY ELSE LEAST(started_at - INTERVAL 1 DAY, GREATEST(started_at - INTERVAL 14 DAY, last)) END AS since FROM l"""
)
def arrival_window(spark, d):
    return ledger.arrival_window(v.runs(spark, d))


SLICES = "slices AS (SELECT run_id, position, MIN(list_sort(source_ids)) AS ids FROM candidates GROUP BY 1, 2)"
#: Half of the corpus, whatever its size, counts as new.
SINCE = "2024-01-20 00:00:00"
MEASURED = f"""k AS (SELECT s.run_id, s.position, x.id, x.id % 6 = 0 AS again FROM slices s, unnest(list_distinct(s.ids)) AS x(id)),
j AS (SELECT k.*, m.type, m.source_type, m.project, m.created_at, m.id IS NOT NULL AS there FROM k LEFT JOIN (SELECT * FROM memories WHERE id % 10 <> 7) m USING (id)),
px AS (SELECT run_id, position, source_type, COUNT(*) AS n FROM j WHERE there GROUP BY ALL), pj AS (SELECT run_id, position, project, COUNT(*) AS n FROM j WHERE there AND project IS NOT NULL GROUP BY ALL),
mixes AS (SELECT run_id, position, string_agg(source_type || ':' || n, ',' ORDER BY source_type) AS source_mix, COUNT(*) AS source_types, MAX(n) AS top, arg_min(source_type, (-n, source_type)) AS dominant_source FROM px GROUP BY 1, 2),
tops AS (SELECT run_id, position, arg_min(project, (-n, project)) AS top_project FROM pj GROUP BY 1, 2),
totals AS (SELECT run_id, position, COUNT(*) AS requested, COUNT(*) FILTER (there) AS resolved, COUNT(*) FILTER (there AND created_at >= TIMESTAMP '{SINCE}') AS fresh, COUNT(*) FILTER (there AND type IN ('learning', 'reference')) AS epi, COUNT(DISTINCT CASE WHEN there THEN id END) AS distinct_parents, COUNT(*) FILTER (again) AS agains FROM j GROUP BY 1, 2),
measured AS (SELECT t.run_id, t.position, requested, resolved, CASE WHEN resolved > 0 THEN round(fresh / resolved, 3) ELSE 0 END AS arrival_share, source_mix, COALESCE(source_types, 0) AS source_types, CASE WHEN resolved > 0 THEN round(top / resolved, 3) ELSE 0 END AS concentration, COALESCE(dominant_source, '') AS dominant_source,
  CASE WHEN resolved > 0 THEN round(epi / resolved, 3) ELSE 0 END AS episodic_share, distinct_parents, round(agains / requested, 3) AS revisit_share, top_project, CASE WHEN resolved > 0 THEN round(fresh / resolved, 3) ELSE 0 END >= 0.6 AND COALESCE(source_types, 0) >= 2 AS anchored FROM totals t LEFT JOIN mixes USING (run_id, position) LEFT JOIN tops USING (run_id, position))"""


def _measured(spark, d):
    """The first candidate of each run and position as a slice."""
    rows = v.memories(spark, d).withColumn("parent_id", F.lit(None).cast("long"))
    slices = v.candidates(spark, d).groupBy("run_id", "position").agg(F.min(F.array_sort("source_ids")).alias("ids"))
    return ledger.slice_metrics(slices, rows.where("id % 10 <> 7"), SINCE, rows.where("id % 6 = 0"), ("learning", "reference"))


def _mix(df):
    entries = F.transform(F.map_entries("source_mix"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return df.withColumn("source_mix", F.when(F.col("source_mix").isNotNull(), F.array_join(entries, ",")))


@query(with_views(MEMORIES, CANDIDATES, SLICES, MEASURED) + "SELECT * FROM measured")
def slice_metrics(spark, d):
    return _mix(_measured(spark, d))


@query(
    with_views(MEMORIES, CANDIDATES, SLICES, MEASURED)
    + """, x AS (SELECT run_id, source_type, SUM(n) AS n FROM px GROUP BY 1, 2), m AS (SELECT run_id, string_agg(source_type || ':' || n, ',' ORDER BY source_type) AS source_mix, COUNT(*) AS source_types, MAX(n) AS top FROM x GROUP BY 1),
t AS (SELECT run_id, COUNT(*) AS slices, SUM(resolved)::BIGINT AS memories, COUNT(*) FILTER (anchored) AS anchored, COALESCE(((2 * SUM(round(arrival_share * 1000)::BIGINT * resolved)::BIGINT + SUM(resolved)::BIGINT) // NULLIF(2 * SUM(resolved)::BIGINT, 0)) / 1000.0::DOUBLE, 0) AS arrival_share, COALESCE(((2 * SUM(round(episodic_share * 1000)::BIGINT * resolved)::BIGINT + SUM(resolved)::BIGINT) // NULLIF(2 * SUM(resolved)::BIGINT, 0)) / 1000.0::DOUBLE, 0) AS episodic_share, COALESCE(((2 * SUM(round(revisit_share * 1000)::BIGINT * resolved)::BIGINT + SUM(resolved)::BIGINT) // NULLIF(2 * SUM(resolved)::BIGINT, 0)) / 1000.0::DOUBLE, 0) AS revisit_share FROM measured GROUP BY 1)
SELECT t.*, source_mix, source_types, COALESCE(round(top / memories, 3), 0)::DOUBLE AS concentration FROM t LEFT JOIN m USING (run_id)"""
)
def run_metrics(spark, d):
    return _mix(ledger.run_metrics(_measured(spark, d)))


@query(
    with_views(MEMORIES, CANDIDATES, SLICES, MEASURED)
    + """, t AS (SELECT *, concentration >= 0.8 AND NOT anchored AS tight FROM measured WHERE resolved > 0),
r AS (SELECT *, COUNT(*) OVER (PARTITION BY run_id, dominant_source, tight) AS crowd, ROW_NUMBER() OVER (PARTITION BY run_id, dominant_source, tight ORDER BY position) AS nth FROM t)
SELECT run_id, position, dominant_source, tight, COUNT(*) FILTER (anchored) OVER (PARTITION BY run_id) < ceil(COUNT(*) OVER (PARTITION BY run_id) / 2) AS needs_arrivals FROM r WHERE NOT tight OR crowd < 3 OR nth <= 2"""
)
def slice_budget(spark, d):
    return ledger.budget(_measured(spark, d)).select("run_id", "position", "dominant_source", "tight", "needs_arrivals")


@query(
    with_views(MEMORIES)
    + """, t AS (SELECT id, type, source_type, title, (ROW_NUMBER() OVER (PARTITION BY type, source_type ORDER BY created_at DESC, id))::INTEGER AS turn, COUNT(*) OVER (PARTITION BY type, source_type) AS channel_size FROM memories),
r AS (SELECT *, SUM(length(title) + 1) OVER (PARTITION BY type ORDER BY turn, channel_size DESC, source_type ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM t)
SELECT id, type, source_type, turn, running::BIGINT AS running FROM r WHERE running <= 2000"""
)
def interleaved_inventory(spark, d):
    turns = ledger.interleave(v.memories(spark, d), "type", "source_type", [F.desc("created_at"), F.col("id")])
    order = [F.col("turn"), F.desc("channel_size"), F.col("source_type")]
    return ledger.within_characters(turns, "type", order, F.length("title") + 1, 2000).select("id", "type", "source_type", "turn", "running")


#: Quotas of channels in a table with columns part, channel, n, room and total.
QUOTAS = """SELECT channel, quota FROM (
  SELECT channel, base + one + GREATEST(0, LEAST(top - base - one, total - SUM(base + one) OVER (PARTITION BY part) - COALESCE(SUM(top - base - one) OVER (PARTITION BY part ORDER BY n DESC, channel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS quota
  FROM (SELECT *, CASE WHEN base = 0 AND COUNT(*) FILTER (base = 0) OVER (PARTITION BY part ORDER BY n DESC, channel ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= total - SUM(base) OVER (PARTITION BY part) THEN 1 ELSE 0 END AS one
    FROM (SELECT *, LEAST(top, floor(total * sqrt(n) / SUM(sqrt(n)) OVER (PARTITION BY part))::BIGINT) AS base FROM (SELECT *, LEAST(n, room) AS top FROM {t} WHERE n > 0 AND room > 0 AND total > 0))))
WHERE quota > 0"""


@query("WITH c AS (SELECT 0 AS part, source AS channel, COUNT(*) AS n, 12 AS room, 150 AS total FROM documents WHERE lang <> 'en' GROUP BY 2)\n" + QUOTAS.format(t="c"))
def stratified_quotas(spark, d):
    counts = read(spark, d, "documents").where("lang <> 'en'").groupBy(F.col("source").alias("channel")).agg(F.count("*").alias("n"))
    return ledger.stratified(counts, 150, 12)


@query(
    """WITH p AS (SELECT event_type AS budget, ts AS t, event_id AS call_id, floor(value * 10)::BIGINT AS input_tokens, floor(value * 3)::BIGINT AS output_tokens, floor(value * 5)::BIGINT AS cached_tokens, CASE WHEN user_id % 2 = 0 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS ip, CASE WHEN user_id % 2 = 0 THEN 15.0::DOUBLE ELSE 5.0::DOUBLE END AS op FROM events),
c AS (SELECT budget, t, call_id, (input_tokens * ip + output_tokens * op + cached_tokens * ip * 0.1::DOUBLE) / 1e6 AS cost FROM p),
r AS (SELECT *, SUM(cost::DECIMAL(20, 10)) OVER (PARTITION BY budget ORDER BY t, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE AS running FROM c)
SELECT call_id, round(cost, 9) AS cost, round(running, 7) AS running, round(running - cost, 9) < 0.5 AS allowed FROM r"""
)
def spend_cap(spark, d):
    tokens = lambda n: F.floor(F.col("value") * n)
    model = F.when(F.pmod("user_id", F.lit(2)) == 0, "large").otherwise("small")
    usage = read(spark, d, "events").select(F.col("event_type").alias("budget"), F.col("ts").alias("at"), F.col("event_id").alias("call_id"), tokens(10).alias("input_tokens"), tokens(3).alias("output_tokens"), tokens(5).alias("cached_tokens"), model.alias("model"))
    prices = spark.createDataFrame([("large", 3.0, 15.0), ("small", 1.0, 5.0)], "model string, input_price double, output_price double")
    return ledger.spend(usage, prices, 0.5).select("call_id", F.round("cost", 9).alias("cost"), F.round("running", 7).alias("running"), "allowed")


@query(with_views(MEMORIES) + f"SELECT id, title, access_count FROM memories WHERE status = 'active' AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY ORDER BY access_count DESC, confidence DESC, created_at, id LIMIT 25")
def resurfaced(spark, d):
    return briefing.resurfaced(v.memories(spark, d), AS_OF, 90, 25).select("id", "title", "access_count")


@query(
    with_views(MEMORIES, CANDIDATES)
    + """SELECT memory_id, COUNT(*) AS sources, string_agg(DISTINCT project, ',' ORDER BY project) AS projects, COUNT(DISTINCT project) > 1 AS cross_project
FROM (SELECT DISTINCT memory_id, unnest(source_ids) AS id FROM candidates WHERE memory_id IS NOT NULL) x JOIN memories m ON m.id = x.id GROUP BY memory_id"""
)
def insight_sources(spark, d):
    return briefing.insights(v.candidates(spark, d), v.memories(spark, d))


@query(
    with_views(MEMORIES)
    + """, h AS (SELECT * FROM memories ORDER BY confidence DESC, id LIMIT 200), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_type ORDER BY confidence DESC, id) AS n FROM h)
SELECT id, source_type, confidence FROM r WHERE n = 1 ORDER BY confidence DESC, id LIMIT 15"""
)
def first_per_source(spark, d):
    return briefing.first_per_source(v.memories(spark, d), "source_type", [F.desc("confidence"), F.col("id")], 200, 15).select("id", "source_type", "confidence")


PREFERENCES = [("kind", "digest", "mute", 0.0), ("topic", "fr", "less", -1.0), ("topic", "de", "useful", 1.5), ("item", "7", "mute", 0.0), ("item", "12", "useful", 2.0)]
ITEMS = """items AS (SELECT id::VARCHAR AS key, ['contradiction', 'insight', 'resurfaced', 'question', 'digest'][id % 5 + 1] AS kind, project AS topic, id % 4 = 0 AS cross_project, created_at FROM memories),
prefs(target_type, target_key, signal, weight) AS (VALUES ('kind', 'digest', 'mute', 0.0::DOUBLE), ('topic', 'fr', 'less', -1.0), ('topic', 'de', 'useful', 1.5), ('item', '7', 'mute', 0.0), ('item', '12', 'useful', 2.0)),
weighed AS (SELECT i.*, COALESCE((SELECT SUM(weight) FROM prefs WHERE (target_type = 'item' AND target_key = key) OR (target_type = 'kind' AND target_key = kind) OR (target_type = 'topic' AND target_key = topic)), 0.0) AS weight FROM items i
  WHERE NOT EXISTS (SELECT 1 FROM prefs WHERE signal = 'mute' AND ((target_type = 'item' AND target_key = key) OR (target_type = 'kind' AND target_key = kind) OR (target_type = 'topic' AND target_key = topic))))"""


def _items(spark, d):
    kinds = v.pick(tuple(briefing.PRIORITY), F.col("id"))
    items = v.memories(spark, d).select(F.col("id").cast("string").alias("key"), kinds.alias("kind"), F.col("project").alias("topic"), (F.pmod("id", F.lit(4)) == 0).alias("cross_project"), "created_at")
    prefs = spark.createDataFrame(PREFERENCES, "target_type string, target_key string, signal string, weight double")
    return briefing.preferred(items, prefs)


@query(with_views(MEMORIES, ITEMS) + "SELECT key, kind, topic, weight FROM weighed")
def preference_weights(spark, d):
    return _items(spark, d).select("key", "kind", "topic", "weight")


@query(with_views(MEMORIES, ITEMS) + "SELECT key, kind, weight FROM weighed ORDER BY list_position(['contradiction', 'insight', 'resurfaced', 'question', 'digest'], kind), cross_project DESC, weight DESC, created_at DESC, key LIMIT 5")
def briefing_items(spark, d):
    return briefing.ranked(_items(spark, d), 5).select("key", "kind", "weight")


@query("""SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def upsert_latest(spark, d):
    e = read(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value")
    half = F.pmod("event_id", F.lit(2)) == 0
    return store.upsert_latest(e.where(half), e.where(~half), ["user_id", "event_type"], ["ts", "event_id"])


@query(
    with_views(MEMORIES)
    + "SELECT m.id, m.access_count + COALESCE(e.n, 0) AS access_count, GREATEST(e.at, CASE WHEN m.id % 2 = 0 THEN m.created_at END) AS last_accessed_at FROM memories m LEFT JOIN (SELECT user_id AS id, COUNT(*) AS n, MAX(ts) AS at FROM events GROUP BY 1) e ON e.id = m.id"
)
def access_bump(spark, d):
    uses = read(spark, d, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("at"))
    return store.bump(v.memories(spark, d).select("id", "access_count", F.when(F.col("id") % 2 == 0, F.col("created_at")).alias("last_accessed_at")), uses)


@query(
    with_views(MEMORIES)
    + """, stored AS (SELECT * FROM memories WHERE id % 3 <> 0), staged AS (SELECT id AS position, source_type, 'https://h' || (id % 13) || '.example.com/d/' || (id - id % 2) AS url, CASE WHEN id % 5 = 0 THEN content || ' more' ELSE content END AS content, ['new'] AS tags, CASE WHEN id % 2 = 0 THEN project END AS project FROM memories),
once AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_type, url ORDER BY position DESC) AS n FROM staged) WHERE n = 1)
SELECT o.source_type, o.url, s.id AS stored_id, CASE WHEN s.id IS NULL THEN 'new' WHEN sha256(s.content) = sha256(o.content) THEN 'unchanged' ELSE 'changed' END AS action, array_to_string(COALESCE(s.tags, []) || o.tags, ',') AS tags, COALESCE(o.project, s.project) AS project
FROM once o LEFT JOIN stored s ON s.source_type = o.source_type AND s.url = o.url"""
)
def ingest_actions(spark, d):
    m = v.memories(spark, d)
    i = F.col("id")
    url = F.concat(F.lit("https://h"), F.pmod(i, F.lit(13)).cast("string"), F.lit(".example.com/d/"), (i - F.pmod(i, F.lit(2))).cast("string"))
    text = F.when(F.pmod(i, F.lit(5)) == 0, F.concat("content", F.lit(" more"))).otherwise(F.col("content"))
    staged = m.select(i.alias("position"), "source_type", url.alias("url"), text.alias("content"), F.array(F.lit("new")).alias("tags"), F.when(F.pmod(i, F.lit(2)) == 0, F.col("project")).alias("project"))
    return store.ingest_actions(staged, m.where(F.pmod(i, F.lit(3)) != 0)).select("source_type", "url", "stored_id", "action", F.array_join("tags", ",").alias("tags"), "project")


@query(
    with_views(MEMORIES)
    + """, stored AS (SELECT id, source_type AS prefix, status FROM memories WHERE id % 4 <> 0), selected AS (SELECT id, (id * 37 % 100) / 100.0::DOUBLE AS confidence FROM memories WHERE id % 10 <> 1),
x AS (SELECT id, s.prefix, COALESCE(s.status = 'active', FALSE) AS active, s.status, c.confidence FROM stored s FULL JOIN selected c USING (id)),
m AS (SELECT *, CASE WHEN active AND confidence IS NULL THEN 'deleted' WHEN active AND confidence < 0.45 THEN 'below' WHEN status IS NULL AND confidence >= 0.55 THEN 'create' WHEN NOT active AND status IS NOT NULL AND confidence >= 0.55 THEN 'reactivate' ELSE 'keep' END AS decision FROM x),
g AS (SELECT t.prefix FROM (SELECT prefix, COUNT(*) FILTER (status = 'active') AS n FROM stored GROUP BY 1) t JOIN (SELECT prefix, COUNT(*) AS lost FROM m WHERE decision IN ('deleted', 'below') GROUP BY 1) l ON l.prefix = t.prefix WHERE lost > GREATEST(25, n // 10))
SELECT id, prefix, CASE WHEN prefix IN (SELECT prefix FROM g) AND decision IN ('deleted', 'below') THEN 'withheld' ELSE decision END AS decision FROM m"""
)
def selection_reconcile(spark, d):
    m, i = v.memories(spark, d), F.col("id")
    stored = m.where(F.pmod(i, F.lit(4)) != 0).select("id", F.col("source_type").alias("prefix"), "status")
    selected = m.where(F.pmod(i, F.lit(10)) != 1).select("id", (F.pmod(i * 37, F.lit(100)) / 100.0).alias("confidence"))
    return store.reconcile(stored, selected)


@query(
    with_views(MEMORIES)
    + "SELECT id, CASE WHEN id % 3 = 0 THEN 'patched ' || title ELSE title END AS title, COALESCE(CASE WHEN id % 6 = 0 THEN 'archived' END, status) AS status FROM memories"
)
def patched_rows(spark, d):
    m, i = v.memories(spark, d).select("id", "title", "status"), F.col("id")
    patches = m.where(F.pmod(i, F.lit(3)) == 0).select("id", F.concat(F.lit("patched "), "title").alias("title"), F.when(F.pmod(i, F.lit(6)) == 0, "archived").alias("status"))
    return store.patch(m, patches, "id")


@query(with_views(CANDIDATES) + "SELECT run_id, position, strategy FROM candidates WHERE run_id % 3 <> 0 UNION ALL SELECT run_id, position, 'new' FROM candidates WHERE run_id % 3 = 0 AND position = 1")
def replaced_by_run(spark, d):
    c = v.candidates(spark, d).select("run_id", "position", "strategy")
    third = F.pmod("run_id", F.lit(3)) == 0
    fresh = c.where(third & (F.col("position") == 1)).withColumn("strategy", F.lit("new"))
    return store.replace_by(c.where(~third | (F.col("position") > 1)), fresh, "run_id").where(~third | (F.col("strategy") == "new"))

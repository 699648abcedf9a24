"""Queries over corpus rows, their children, arrivals and freshness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus, monitor
from . import views as v
from .registry import query
from .views import AS_OF, CHUNKS, MEMORIES, RUNS, read, with_views

ALL = """everything AS (
  SELECT id, NULL::BIGINT AS parent_id, source_type, type FROM memories UNION ALL SELECT id, parent_id, source_type, 'chunk' FROM chunks)"""


@query(with_views(MEMORIES, CHUNKS, ALL) + "SELECT COALESCE(source_type, 'generated:' || type) AS label, COUNT(DISTINCT COALESCE(parent_id, id)) AS documents, COUNT(*) AS memories FROM everything GROUP BY 1")
def arrivals_summary(spark, d):
    rows = v.memories(spark, d).select("id", F.lit(None).cast("long").alias("parent_id"), "source_type", "type")
    return corpus.arrivals(rows.unionByName(v.chunks(spark, d).select("id", "parent_id", "source_type", F.lit("chunk").alias("type"))))


@query(with_views(MEMORIES) + "SELECT source_type, id, title, rank FROM (SELECT *, (ROW_NUMBER() OVER (PARTITION BY source_type ORDER BY created_at DESC, id))::INTEGER AS rank FROM memories) WHERE rank <= 5")
def newest_per_channel(spark, d):
    return corpus.newest_per(v.memories(spark, d), "source_type", 5).select("source_type", "id", "title", "rank")


@query(with_views(MEMORIES) + "SELECT md5(content) AS hash, arg_min(id, (created_at, id)) AS keep, COUNT(*) AS copies FROM memories GROUP BY 1 HAVING COUNT(*) > 1")
def duplicate_groups(spark, d):
    return corpus.duplicate_groups(v.memories(spark, d).withColumn("hash", F.md5(F.col("content").cast("binary"))), ["hash"])


@query(with_views(MEMORIES, CHUNKS) + "SELECT id, title FROM memories m WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.parent_id = m.id AND c.status = 'active')")
def parents_without_chunks(spark, d):
    return corpus.parents_without_chunks(v.memories(spark, d), v.chunks(spark, d)).select("id", "title")


@query(with_views(MEMORIES, CHUNKS) + "SELECT id, parent_id, chunk_index FROM chunks c WHERE status = 'active' AND NOT EXISTS (SELECT 1 FROM memories m WHERE m.id = c.parent_id AND m.status = 'active' AND m.type <> 'schema')")
def chunk_collapse(spark, d):
    parents = v.memories(spark, d).where("status = 'active' AND type <> 'schema'")
    return corpus.collapse_chunks(v.chunks(spark, d).where("status = 'active'"), parents).select("id", "parent_id", "chunk_index")


@query(with_views(CHUNKS) + "SELECT status, COUNT(*) AS n, SUM(length(content))::BIGINT AS characters FROM chunks WHERE NOT (parent_id IS NOT NULL AND status = 'superseded') GROUP BY status")
def current_chunks(spark, d):
    rows = v.chunks(spark, d).where(corpus.not_history(F.col("parent_id"), F.col("status")))
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("characters"))


@query(with_views(MEMORIES) + "SELECT id, length(content) AS length FROM memories WHERE length(content) > 4000")
def oversize_rows(spark, d):
    return corpus.oversize(v.memories(spark, d), 4000).withColumn("length", F.col("length").cast("long"))


@query(with_views(MEMORIES) + "SELECT tag, COUNT(*) AS n FROM (SELECT unnest(tags) AS tag FROM memories WHERE status = 'active') GROUP BY tag ORDER BY n DESC, tag LIMIT 25")
def tag_histogram(spark, d):
    return corpus.tag_histogram(v.memories(spark, d).where("status = 'active'"), 25)


@query("SELECT label, n::INTEGER AS place, round(avg(x::DOUBLE), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS n FROM embeddings) GROUP BY 1, 2")
def centroids(spark, d):
    return corpus.centroids(read(spark, d, "embeddings"), "label").select("label", F.posexplode("centroid").alias("place", "mean")).withColumn("mean", F.round("mean", 6))


@query(with_views(MEMORIES) + "SELECT id, source_type, status, length(content) AS length, sha256(content) AS hash FROM memories")
def text_digests(spark, d):
    return corpus.stream_digest(v.memories(spark, d)).withColumn("length", F.col("length").cast("long"))


@query(
    with_views(MEMORIES, CHUNKS)
    + """, r AS (SELECT id, NULL::BIGINT AS parent_id, CASE WHEN id % 11 = 3 THEN 'insight' ELSE 'source' END AS type, CASE WHEN id % 13 = 5 THEN 'distilled_chat' ELSE source_type END AS source_type, CASE WHEN id % 17 <> 2 THEN 'https://e.org/' || left(md5(content), 2) END AS url, project, status, CASE WHEN id % 19 = 4 THEN 'task' END AS record_kind, NULL::INTEGER AS chunk_index, content, created_at FROM memories
  UNION ALL SELECT id, parent_id, 'source', source_type, 'https://e.org/c', project, status, NULL, chunk_index, content, TIMESTAMP '2024-01-01' + to_hours((parent_id % 1000)::INTEGER) FROM chunks),
k AS (SELECT *, sha256(content) AS hash FROM r WHERE type = 'source' AND COALESCE(url, '') <> '' AND source_type <> 'distilled_chat' AND record_kind IS NULL),
p AS (SELECT id, FIRST_VALUE(id) OVER (PARTITION BY source_type, url, project, type, hash, status ORDER BY created_at, id) AS new_id FROM k WHERE parent_id IS NULL),
c AS (SELECT k.id, FIRST_VALUE(k.id) OVER (PARTITION BY COALESCE(p.new_id, k.parent_id), source_type, url, project, type, chunk_index, hash, status ORDER BY created_at, k.id) AS new_id FROM k LEFT JOIN p ON p.id = k.parent_id WHERE k.parent_id IS NOT NULL)
SELECT id AS old_id, new_id, 2 AS pass FROM p WHERE id <> new_id UNION ALL SELECT id, new_id, 1 FROM c WHERE id <> new_id"""
)
def dedup_plan(spark, d):
    return corpus.dedup_plan(_identified(spark, d))


def _identified(spark, d):
    """Documents and chunks with the seven fields that tell captured sources apart, some of them of other kinds."""
    i, null = F.col("id"), F.lit(None)
    parents = v.memories(spark, d).select(
        "id", null.cast("long").alias("parent_id"), F.when(i % 11 == 3, "insight").otherwise("source").alias("type"), F.when(i % 13 == 5, "distilled_chat").otherwise(F.col("source_type")).alias("source_type"),
        F.when(i % 17 != 2, F.concat(F.lit("https://e.org/"), F.left(F.md5(F.col("content").cast("binary")), F.lit(2)))).alias("url"), "project", "status", F.when(i % 19 == 4, "task").alias("record_kind"), null.cast("int").alias("chunk_index"), "content", "created_at",
    )
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.pmod("parent_id", F.lit(1000)).cast("int"))
    pieces = v.chunks(spark, d).withColumns({"type": F.lit("source"), "url": F.lit("https://e.org/c"), "record_kind": null.cast("string"), "created_at": at})
    return parents.unionByName(pieces)


@query(with_views(MEMORIES) + "SELECT id, type, title, source_type, project, status, created_at, access_count FROM memories WHERE type = 'decision' AND (project = 'en' OR project IS NULL) ORDER BY created_at DESC, id LIMIT 40 OFFSET 5")
def recent_page(spark, d):
    return corpus.page(corpus.where(v.memories(spark, d), type="decision", project="en"), 40, 5)


@query(with_views(MEMORIES) + "SELECT e.event_id AS position, m.id, m.title FROM events e JOIN memories m ON m.id = e.user_id ORDER BY position")
def rows_in_order(spark, d):
    ids = read(spark, d, "events").select(F.col("event_id").alias("position"), F.col("user_id").alias("id"))
    return corpus.many(v.memories(spark, d).select("id", "title"), ids).select("position", "id", "title")


@query(
    with_views(MEMORIES)
    + f""", policy AS (SELECT DISTINCT source AS channel, 20 AS max_age_days FROM documents UNION ALL SELECT 'never-seen', 20),
n AS (SELECT source_type AS channel, MAX(created_at) AS newest FROM memories GROUP BY 1)
SELECT channel, COALESCE(date_diff('day', newest::DATE, DATE '{AS_OF[:10]}'), 99999)::INTEGER AS age, COALESCE(date_diff('day', newest::DATE, DATE '{AS_OF[:10]}'), 99999) > max_age_days AS overdue FROM policy LEFT JOIN n USING (channel)"""
)
def channel_ages(spark, d):
    named = read(spark, d, "documents").select(F.col("source").alias("channel")).distinct()
    policy = named.union(spark.createDataFrame([("never-seen",)], "channel string")).withColumn("max_age_days", F.lit(20))
    return monitor.channel_ages(v.memories(spark, d), policy, AS_OF)


@query(
    """WITH days AS (SELECT DISTINCT event_type AS key, ts::DATE AS day FROM events WHERE value > 60),
g AS (SELECT key, date_diff('day', LAG(day) OVER (PARTITION BY key ORDER BY day), day) AS g FROM days)
SELECT key, COUNT(*) AS days, GREATEST(2, COALESCE(MAX(g), 0) + 1)::INTEGER AS gap FROM g GROUP BY key"""
)
def cadence_gap(spark, d):
    rows = read(spark, d, "events").where("value > 60").select(F.col("event_type").alias("key"), F.col("ts").alias("created_at"))
    return monitor.cadence(rows, "key").withColumn("gap", F.col("gap").cast("int"))


@query(
    with_views(RUNS)
    + """, r AS (SELECT run_type, MAX(CASE WHEN generated > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run_type ORDER BY started_at DESC, run_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS any_yet FROM runs WHERE completed_at IS NOT NULL)
SELECT run_type, COUNT(*) FILTER (any_yet = 0) AS streak FROM r GROUP BY run_type"""
)
def zero_streak(spark, d):
    return monitor.zero_streak(v.runs(spark, d))


@query(
    with_views(MEMORIES)
    + f""", w AS (SELECT unnest({list(v.TYPES)} || ['never']) AS type), l AS (SELECT type, MAX(created_at::DATE) AS last_day FROM memories WHERE status = 'active' GROUP BY type)
SELECT type, last_day, COALESCE(date_diff('day', last_day, DATE '{AS_OF[:10]}') > 30, TRUE) AS silent FROM w LEFT JOIN l USING (type)"""
)
def zero_output(spark, d):
    wanted = spark.createDataFrame([(t,) for t in (*v.TYPES, "never")], "type string")
    return monitor.zero_output(v.memories(spark, d).where("status = 'active'"), wanted, AS_OF, 30)


@query("""SELECT user_id AS key, COUNT(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, bool_or(event_type IN ('purchase', 'click')) AS engaged, MIN(ts) AS first_at, MAX(ts) AS last_at FROM events GROUP BY 1""")
def interaction_summary(spark, d):
    return monitor.interaction_summary(read(spark, d, "events").select(F.col("user_id").alias("key"), "event_type", F.col("ts").alias("at")))


VISITS = """visits AS (SELECT ts AS seen, 'https://h' || (user_id % 17) || '.example.com/p/' || (user_id % 40) AS url, 'h' || (user_id % 17) || '.example.com' AS host, CAST(floor(value) AS BIGINT) AS seconds,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE 'title ' || event_id END AS title FROM events)"""


@query(
    with_views(VISITS)
    + """SELECT seen::DATE AS day, url, host, SUM(LEAST(seconds, 40))::BIGINT AS seconds, COUNT(*) AS visits, MIN(seen) AS first_at, arg_min(title, seen) FILTER (title <> '') AS title FROM visits GROUP BY 1, 2, 3"""
)
def attention_by_page(spark, d):
    e = read(spark, d, "events")
    num = lambda n: F.pmod("user_id", F.lit(n)).cast("string")
    visits = e.select(
        F.col("ts").alias("at"), F.concat(F.lit("https://h"), num(17), F.lit(".example.com/p/"), num(40)).alias("url"), F.concat(F.lit("h"), num(17), F.lit(".example.com")).alias("host"),
        F.floor("value").alias("seconds"), F.when(F.pmod("event_id", F.lit(3)) == 0, "").otherwise(F.concat(F.lit("title "), F.col("event_id").cast("string"))).alias("title"),
    )
    return monitor.dwell(visits, 40)


@query(
    """WITH a AS (SELECT user_id AS key, event_id AS id, ts AS arrived_at, CASE WHEN event_type = 'purchase' THEN ts + INTERVAL 1 HOUR END AS done_at FROM events),
c AS (SELECT key, MAX(arrived_at) AS covered FROM a WHERE done_at IS NOT NULL GROUP BY key) SELECT key, id, arrived_at FROM a JOIN c USING (key) WHERE done_at IS NULL AND arrived_at <= covered"""
)
def covering_backlog(spark, d):
    done = F.when(F.col("event_type") == "purchase", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    a = read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("arrived_at"), done.alias("done_at"))
    return monitor.covering_backlog(a, a.where("done_at IS NOT NULL"))


@query()
def strike_ledger(spark, d):
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "ok").otherwise("deferred")
    return monitor.strikes(read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), outcome.alias("outcome")))


@query(
    with_views(MEMORIES, RUNS)
    + f""", a AS (SELECT source_type AS subject, date_diff('day', MAX(created_at)::DATE, DATE '{AS_OF[:10]}') AS age FROM memories GROUP BY 1),
r AS (SELECT run_type AS subject, date_diff('day', MAX(completed_at)::DATE, DATE '1998-12-01') AS age FROM runs GROUP BY 1)
SELECT 'channel' AS "check", subject, CASE WHEN age > 60 THEN 'error' ELSE 'warning' END AS severity, age || ' days' AS detail FROM a WHERE age > 20
UNION ALL SELECT 'run', subject, CASE WHEN age > 60 THEN 'error' ELSE 'warning' END, age || ' days' FROM r WHERE age > 20"""
)
def liveness_findings(spark, d):
    age = lambda rows, key, at, until: rows.groupBy(F.col(key).alias("subject")).agg(F.date_diff(F.lit(until).cast("date"), F.max(at).cast("date")).alias("age"))
    found = lambda name, rows: rows.where("age > 20").select(F.lit(name).alias("check"), "subject", F.when(F.col("age") > 60, "error").otherwise("warning").alias("severity"), F.concat(F.col("age").cast("string"), F.lit(" days")).alias("detail"))
    return monitor.findings(found("channel", age(v.memories(spark, d), "source_type", "created_at", AS_OF[:10])), found("run", age(v.runs(spark, d), "run_type", "completed_at", "1998-12-01")))

"""Queries of capture: eligibility, seen sets, mappings, checks of inputs, backups and streaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import capture
from ..functions.text import project_tag
from ..streaming import turns
from . import views as v
from .registry import query
from .views import AS_OF, CHUNKS, EPOCH, MEMORIES, RUNS, read, with_views

#: Rows with metadata as JSON text, some of it absent.
TRACKED = """tracked AS (
  SELECT *, NULL::BIGINT AS parent_id, CASE id % 8 WHEN 0 THEN '{"own_synthesis": "true"}' WHEN 1 THEN '{"record_kind": "topic_segment_chunk"}' WHEN 2 THEN '{"maintenance_manifest": null}'
    WHEN 3 THEN '{"captured_at": "2024-0' || (1 + id % 9) || '-15 10:00:00"}' WHEN 4 THEN '{"captured_at": "soon"}' WHEN 5 THEN '{}' END AS metadata, CASE WHEN id % 10 = 9 THEN ['own-synthesis', 'x'] WHEN id % 10 = 8 THEN NULL ELSE tags END AS labels FROM memories)"""
ARRIVED = "parent_id IS NULL AND status IS DISTINCT FROM 'superseded' AND NOT COALESCE(list_contains(labels, 'own-synthesis'), false) AND COALESCE(json_extract_string(metadata, '$.own_synthesis'), 'false') <> 'true'"


def tracked(spark, d):
    i = F.pmod("id", F.lit(8))
    told = F.concat(F.lit('{"captured_at": "2024-0'), (1 + F.pmod("id", F.lit(9))).cast("string"), F.lit('-15 10:00:00"}'))
    texts = {0: F.lit('{"own_synthesis": "true"}'), 1: F.lit('{"record_kind": "topic_segment_chunk"}'), 2: F.lit('{"maintenance_manifest": null}'), 3: told, 4: F.lit('{"captured_at": "soon"}'), 5: F.lit("{}")}
    metadata = F.lit(None).cast("string")
    for k, text in texts.items():
        metadata = F.when(i == k, text).otherwise(metadata)
    tens = F.pmod("id", F.lit(10))
    tags = F.when(tens == 9, F.array(F.lit("own-synthesis"), F.lit("x"))).when(tens != 8, F.col("tags"))
    return v.memories(spark, d).withColumns({"parent_id": F.lit(None).cast("long"), "metadata": metadata, "tags": tags})


def arrivals_of(spark, d):
    return tracked(spark, d).where(capture.arrived("own-synthesis", "own_synthesis"))


@query(with_views(MEMORIES, TRACKED) + f"SELECT id, source_type FROM tracked WHERE {ARRIVED}")
def arrival_rows(spark, d):
    return arrivals_of(spark, d).select("id", "source_type")


@query(with_views(MEMORIES, TRACKED) + "SELECT id FROM tracked WHERE COALESCE(json_extract_string(metadata, '$.record_kind'), '') NOT IN ('topic_segment_chunk', 'task_memory_chunk') AND NOT COALESCE(list_contains(json_keys(metadata), 'maintenance_manifest'), false)")
def capture_evidence(spark, d):
    return tracked(spark, d).where(capture.captured()).select("id")


CHUNKED = """marked AS (SELECT id, parent_id, CASE id % 3 WHEN 0 THEN '{"chunk_index": ' || chunk_index || '}' WHEN 1 THEN '{"record_kind": "task_memory_chunk"}' END AS metadata FROM chunks UNION ALL SELECT id, NULL, '{"chunk_index": 1}' FROM memories)"""


@query(with_views(MEMORIES, CHUNKS, CHUNKED) + "SELECT id, parent_id IS NOT NULL AND (json_extract_string(metadata, '$.chunk_index') IS NOT NULL OR COALESCE(right(json_extract_string(metadata, '$.record_kind'), 6), '') = '_chunk') AS index_only FROM marked")
def chunk_rows(spark, d):
    kinds = F.when(F.col("id") % 3 == 0, F.concat(F.lit('{"chunk_index": '), F.col("chunk_index").cast("string"), F.lit("}"))).when(F.col("id") % 3 == 1, '{"record_kind": "task_memory_chunk"}')
    rows = v.chunks(spark, d).select("id", "parent_id", kinds.alias("metadata")).unionByName(v.memories(spark, d).select("id", F.lit(None).cast("long").alias("parent_id"), F.lit('{"chunk_index": 1}').alias("metadata")))
    return rows.select("id", capture.chunk_row().alias("index_only"))


@query(with_views(MEMORIES, TRACKED) + "SELECT source_type, MAX(GREATEST(created_at, TRY_CAST(json_extract_string(metadata, '$.captured_at') AS TIMESTAMP))) AS last FROM tracked GROUP BY 1")
def last_captures(spark, d):
    return capture.last_captures(tracked(spark, d), "captured_at")


TASKS = """tasks AS (SELECT event_id AS task_id, ['exec', 'cli', '{"subagent": {"kind": "review"}}', '{"vscode": 1}', NULL][event_id % 5 + 1] AS source, ['user', 'subagent', NULL][event_id % 3 + 1] AS thread_source,
  CASE event_id % 13 WHEN 0 THEN 'agents/a' WHEN 1 THEN '' END AS agent_path FROM events), spawns AS (SELECT user_id AS parent_id, event_id AS child_id FROM events WHERE value > 400 UNION ALL SELECT user_id + 1, event_id FROM events WHERE value > 450)"""


@query(
    with_views(TASKS)
    + """, s AS (SELECT *, task_id IN (SELECT child_id FROM spawns) AS spawned FROM tasks) SELECT task_id, spawned, CASE WHEN spawned OR COALESCE(agent_path, '') <> '' OR thread_source IS NOT DISTINCT FROM 'subagent' OR COALESCE(source, '') LIKE '{"subagent"%' THEN 'delegated' WHEN source = 'exec' THEN 'unknown' WHEN thread_source = 'user' THEN 'user' ELSE 'unknown' END AS ownership FROM s"""
)
def task_ownership(spark, d):
    e = read(spark, d, "events")
    kinds = [F.lit(x) for x in ("exec", "cli", '{"subagent": {"kind": "review"}}', '{"vscode": 1}')] + [F.lit(None).cast("string")]
    pick = lambda xs, n: F.element_at(F.array(*xs), (F.pmod("event_id", F.lit(n)) + 1).cast("int"))
    path = F.pmod("event_id", F.lit(13))
    tasks = e.select(F.col("event_id").alias("task_id"), pick(kinds, 5).alias("source"), pick([F.lit("user"), F.lit("subagent"), F.lit(None).cast("string")], 3).alias("thread_source"), F.when(path == 0, "agents/a").when(path == 1, "").alias("agent_path"))
    spawns = e.where("value > 400").select("user_id", F.col("event_id").alias("child_id")).unionByName(e.where("value > 450").select((F.col("user_id") + 1).alias("user_id"), F.col("event_id").alias("child_id")))
    return capture.owned_tasks(tasks, spawns).select("task_id", "spawned", "ownership")


@query("SELECT conv_id, COUNT(*) AS message_count FROM conversations WHERE conv_id % 9 <> 0 AND conv_id % 7 <> 0 GROUP BY conv_id HAVING COUNT(*) >= 2")
def eligible_sessions(spark, d):
    c = F.col("conv_id")
    own = read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("message_count"))
    flags = {"deleted_at": F.when(c % 9 == 0, F.lit(EPOCH)), "private": F.when(c % 7 == 0, 1).when(c % 5 == 0, 0)}
    return capture.eligible_sessions(own.withColumns(flags)).select("conv_id", "message_count")


@query("""SELECT c_custkey AS id, c_name AS title, CASE WHEN o.node IS NULL OR o.text_content IS NULL OR o.text_content = '' THEN c_name ELSE o.text_content END AS content, 'qd://entity/' || c_custkey AS url
FROM customer LEFT JOIN (SELECT o_custkey AS node, CASE WHEN MIN(o_orderkey) % 3 = 0 THEN '' WHEN MIN(o_orderkey) % 3 = 1 THEN 'order ' || MIN(o_orderkey) END AS text_content FROM orders GROUP BY 1) o ON o.node = c_custkey WHERE c_custkey % 2 = 0 AND c_custkey > 10""")
def assistant_decisions(spark, d):
    entities = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "Decision").otherwise("Person").alias("category"), F.col("c_name").alias("name"), F.col("c_custkey").alias("node"))
    first = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("node")).agg(F.min("o_orderkey").alias("k"))
    contents = first.select("node", F.when(F.col("k") % 3 == 0, "").when(F.col("k") % 3 == 1, F.concat(F.lit("order "), F.col("k").cast("string"))).alias("text_content"))
    return capture.decisions(entities, first.select(F.col("node").alias("id")), contents, 10)


CATEGORY = "['people', 'terminology', 'profile', 'anti-pattern', 'mystery', NULL][id % 6 + 1]"


@query(
    with_views(MEMORIES)
    + f""", r AS (SELECT id, {CATEGORY} AS category, CASE WHEN id % 5 = 0 THEN 'procedure' WHEN id % 5 = 1 THEN 'fact' ELSE 'note' END AS memory_type, CASE WHEN id % 4 = 0 THEN title END AS name, content AS text, confidence FROM memories)
SELECT 'qd://memory/' || id AS url, CASE WHEN memory_type = 'procedure' THEN 'insight' ELSE COALESCE(CASE category WHEN 'people' THEN 'source' WHEN 'terminology' THEN 'research' WHEN 'profile' THEN 'source' WHEN 'anti-pattern' THEN 'insight' END, 'source') END AS type,
  CASE WHEN memory_type = 'procedure' THEN 'quick_desktop_procedure' ELSE COALESCE(CASE category WHEN 'people' THEN 'quick_desktop_people' WHEN 'terminology' THEN 'quick_desktop_terminology' WHEN 'profile' THEN 'quick_desktop_profile' WHEN 'anti-pattern' THEN 'quick_desktop_anti_pattern' END, 'quick_desktop') END AS source_type,
  CASE WHEN COALESCE(name, '') <> '' THEN name ELSE left(trim(split_part(text, chr(10), 1)), 80) END AS title, ['qd:' || COALESCE(category, 'uncategorized'), 'qd_type:' || memory_type] AS tags, CASE WHEN memory_type = 'fact' THEN 'semantic' ELSE 'procedural' END AS mem_class, confidence FROM r"""
)
def assistant_mapping(spark, d):
    i = F.col("id")
    kinds = F.array(*[F.lit(x) for x in ("people", "terminology", "profile", "anti-pattern", "mystery")], F.lit(None).cast("string"))
    rows = v.memories(spark, d).select(
        "id", F.element_at(kinds, (F.pmod(i, F.lit(6)) + 1).cast("int")).alias("category"), F.when(i % 5 == 0, "procedure").when(i % 5 == 1, "fact").otherwise("note").alias("memory_type"), F.when(i % 4 == 0, F.col("title")).alias("name"), F.col("content").alias("text"), "confidence"
    )
    return capture.mapped(rows)


@query(
    """WITH p AS (SELECT page_id AS node_id, page_id % 3 AS chunk_index, CASE WHEN page_id % 4 <> 0 THEN url END AS path, CASE page_id % 3 WHEN 0 THEN '/home/My Docs/' WHEN 1 THEN '' END AS folder, CASE WHEN page_id % 2 = 0 THEN '.html' END AS extension FROM pages),
n AS (SELECT *, CASE WHEN COALESCE(path, '') <> '' THEN string_split(path, '/')[-1] ELSE 'Unknown Document' END AS name FROM p)
SELECT node_id, 'qd-doc://' || node_id AS url, CASE WHEN chunk_index > 0 THEN name || ' (chunk ' || chunk_index || ')' ELSE name END AS title, list_concat(['qd-doc'], CASE WHEN extension IS NOT NULL THEN ['html'] ELSE [] END, CASE WHEN COALESCE(folder, '') <> '' THEN ['my-docs'] ELSE [] END) AS tags,
  '{"node_id":' || node_id || ',"chunk_index":' || chunk_index || ',"folder_path":' || COALESCE('"' || folder || '"', 'null') || ',"extension":' || COALESCE('"' || extension || '"', 'null') || '}' AS metadata FROM n"""
)
def document_chunks(spark, d):
    i = F.col("page_id")
    rows = read(spark, d, "pages").select(i.alias("node_id"), (i % 3).alias("chunk_index"), F.when(i % 4 != 0, F.col("url")).alias("path"), F.when(i % 3 == 0, "/home/My Docs/").when(i % 3 == 1, "").alias("folder"), F.when(i % 2 == 0, ".html").alias("extension"))
    return capture.document_chunks(rows)


WAITS = ("Retry after 38s.", "Retry-After: 16", "please wait for 2 minutes", "wait 250 ms", '{"timeout": 1500}', "no limit", "WAIT 3 milliseconds")


@query(
    f"SELECT event_id, [38.0, 16.0, 120.0, 0.25, 1.5, NULL, 0.003][event_id % 7 + 1]::DOUBLE AS seconds, [{', '.join(repr('f.N[] must be at most N') for _ in range(2))}, 'title empty'][event_id % 3 + 1] AS reason, 'red ' || event_type AS plain FROM events"
)
def reply_classes(spark, d):
    e = F.col("event_id")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(e, F.lit(len(xs))) + 1).cast("int"))
    messages = ("f.3[12] must be at most 4, got 'x 99'", "f.7[0] must be at most 20; the limit is 20", "title empty")
    rows = read(spark, d, "events").select("event_id", pick(WAITS).alias("wait"), pick(messages).alias("message"), F.concat(F.lit("\u001b[31mred\u001b[0m "), "event_type").alias("coloured"))
    return rows.select("event_id", F.round(capture.retry_after(F.col("wait")), 6).alias("seconds"), capture.reason_key(F.col("message")).alias("reason"), capture.without_ansi(F.col("coloured")).alias("plain"))


@query("SELECT doc_id AS id, length(text) AS original_chars, LEAST(length(text), 20000) AS embedded_chars, length(text) > 20000 AS truncated, trim(text) = '' AS refused, md5(left(text, 20000)) AS input FROM documents")
def leaf_inputs(spark, d):
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")).withColumn("x", capture.leaf_input())
    return rows.select("id", F.col("x.original_chars").cast("long").alias("original_chars"), F.col("x.embedded_chars").cast("long").alias("embedded_chars"), "x.truncated", "x.refused", F.md5(F.coalesce("x.input", "content").cast("binary")).alias("input"))


@query("SELECT vec_id AS id, CASE vec_id % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE [0.5, vec_id::DOUBLE, -1.25] END AS vector FROM embeddings")
def vector_texts(spark, d):
    i = F.col("vec_id")
    text = F.when(i % 5 == 3, "0.5,1").when(i % 5 == 4, "[0.5,x]").otherwise(F.concat(F.lit(" [0.5, "), i.cast("string"), F.lit(",,-1.25] ")))
    return read(spark, d, "embeddings").select(i.alias("id"), capture.parsed_vector(text).alias("vector"))


@query(
    """WITH r AS (SELECT event_id AS request_id, [event_type, ' ', NULL][event_id % 3 + 1] AS kind, ['7', '10000', '-2', 'true', '3.0', '2.5', ''][event_id % 7 + 1] AS l, [NULL, '30', '-1', 'x'][event_id % 4 + 1] AS dd, event_id % 11 AS m, ['a, b ,a', ' , ', 'a,b,c,d,e', NULL][event_id % 4 + 1] AS topics FROM events),
c AS (SELECT *, trim(COALESCE(kind, '')) <> '' AND kind NOT IN ('view', 'click', 'purchase') AS wk, l NOT IN ('7', '10000', '-2', '3.0') AS wl, dd IS NOT DISTINCT FROM 'x' AS wd, m = 1 AS wt, topics IS NULL OR topics <> 'a, b ,a' AS wp FROM r)
SELECT request_id, CASE WHEN NOT wk AND trim(COALESCE(kind, '')) <> '' THEN kind END AS kind, CASE WHEN NOT wl THEN CASE l WHEN '7' THEN 7 WHEN '10000' THEN 100 WHEN '-2' THEN 1 ELSE 3 END END::BIGINT AS "limit", CASE WHEN NOT wd THEN CASE dd WHEN '30' THEN 30 WHEN '-1' THEN 0 END END::BIGINT AS days,
  CASE WHEN NOT wt AND m <> 2 THEN ['t0', 't1'] END AS tags, CASE WHEN NOT wp THEN ['a', 'b'] END AS topics, list_concat(CASE WHEN wk THEN ['kind'] ELSE [] END, CASE WHEN wl THEN ['limit'] ELSE [] END, CASE WHEN wd THEN ['days'] ELSE [] END, CASE WHEN wt THEN ['tags'] ELSE [] END, CASE WHEN wp THEN ['topics'] ELSE [] END) AS errors FROM c"""
)
def checked_requests(spark, d):
    e = F.col("event_id")
    pick = lambda *xs: F.element_at(F.array(*[x if not isinstance(x, str) and x is not None else F.lit(x).cast("string") for x in xs]), (F.pmod(e, F.lit(len(xs))) + 1).cast("int"))
    many = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda n: F.concat(F.lit("t"), n.cast("string")))
    tags = F.when(e % 11 == 1, many).when(e % 11 != 2, F.array(F.lit(" t0 "), F.lit("t1"), F.lit(" "), F.lit("t0")))
    rows = read(spark, d, "events").select(
        e.alias("request_id"), pick(F.col("event_type"), " ", None).alias("kind"), pick("7", "10000", "-2", "true", "3.0", "2.5", "").alias("limit"), pick(None, "30", "-1", "x").alias("days"), tags.alias("tags"), pick("a, b ,a", " , ", "a,b,c,d,e", None).alias("topics")
    )
    return capture.checked(rows, ("view", "click", "purchase"))


@query("SELECT p.page_id, p.url FROM pages p WHERE p.url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def unseen_addresses(spark, d):
    pages = read(spark, d, "pages").select("page_id", "url")
    return capture.unseen(pages, pages.where("page_id % 3 = 0"), "url")


@query(
    """WITH f AS (SELECT page_id, 'p' || page_id AS url, md5(html) AS fingerprint FROM pages) SELECT url, fingerprint, CASE page_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'unknown' ELSE 'changed' END AS state FROM f WHERE page_id % 4 <> 3"""
)
def changed_sources(spark, d):
    i = F.col("page_id")
    found = read(spark, d, "pages").select("page_id", F.concat(F.lit("p"), i.cast("string")).alias("url"), F.md5(F.col("html").cast("binary")).alias("fingerprint"))
    stored = found.where(i % 4 != 0).select("url", F.when(i % 4 == 2, "old").when(i % 4 == 3, F.col("fingerprint")).alias("fingerprint"))
    return capture.changed_sources(found, stored)


@query("SELECT event_id AS visit_id, p.url, 'page ' || p.page_id AS title, e.ts AS visited_at, e.value AS dwell FROM events e JOIN pages p ON p.page_id = e.user_id WHERE e.ts >= TIMESTAMP '2024-01-02 05:00:00' AND e.ts < TIMESTAMP '2024-01-03 05:00:00'")
def day_visits(spark, d):
    visits = read(spark, d, "events").select(F.col("event_id").alias("visit_id"), F.col("user_id").alias("url_id"), F.col("ts").alias("visited_at"), F.col("value").alias("dwell"))
    urls = read(spark, d, "pages").select(F.col("page_id").alias("url_id"), "url", F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"))
    at = lambda day: F.lit(f"2024-01-0{day} 05:00:00").cast("timestamp_ntz")
    return capture.day_visits(visits, urls, at(2), at(3))


@query(
    """WITH w AS (SELECT DISTINCT event_type AS key, TIMESTAMP '2024-01-02' + to_hours(length(event_type)::INTEGER) AS low FROM events) SELECT event_id, key FROM events JOIN w ON key = event_type WHERE ts >= low AND ts < low + INTERVAL 12 HOUR"""
)
def rechecked_windows(spark, d):
    rows = read(spark, d, "events").select("event_id", F.col("event_type").alias("key"), "ts")
    low = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.length("key"))
    windows = rows.select("key").distinct().select("key", low.alias("low")).withColumn("high", F.col("low") + F.expr("INTERVAL 12 HOURS"))
    return capture.within(rows, "ts", windows).select("event_id", "key")


@query(
    with_views(MEMORIES)
    + """SELECT url, source_type, created_at FROM memories m WHERE content IS NOT NULL AND id % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM memories r WHERE r.id % 7 = 0 AND r.url = m.url)"""
)
def undistilled_sessions(spark, d):
    m = v.memories(spark, d).withColumn("parent_id", F.lit(None).cast("long"))
    hash_ = F.sha2(F.when(F.col("id") % 7 == 0, F.col("content")).otherwise(F.lit("another text")).cast("binary"), 256)
    refusals = m.where("id % 7 = 0 OR id % 7 = 1").select("url", F.lit("model").alias("scope"), hash_.alias("input_sha256"))
    return capture.undistilled(m, m.where("id % 5 = 0"), refusals)


@query(
    """WITH i AS (SELECT o_custkey AS session, CASE WHEN o_orderkey % 5 = 0 THEN 'd://' || o_custkey WHEN o_orderkey % 5 = 1 THEN 'd://' || o_custkey || '#x' ELSE 'd://' || o_custkey || '#' || o_orderkey END AS url, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS origin FROM orders)
SELECT session, COUNT(*) AS items, COALESCE(MAX(TRY_CAST(CASE WHEN contains(url, '#') THEN string_split(url, '#')[-1] END AS BIGINT)), -1) AS last_index FROM i GROUP BY session"""
)
def session_states(spark, d):
    k, base = F.col("o_orderkey"), F.concat(F.lit("d://"), F.col("o_custkey").cast("string"))
    url = F.when(k % 5 == 0, base).when(k % 5 == 1, F.concat(base, F.lit("#x"))).otherwise(F.concat(base, F.lit("#"), k.cast("string")))
    items = read(spark, d, "orders").select(F.col("o_custkey").alias("session"), url.alias("url"), F.when(k % 2 == 0, F.col("o_orderpriority")).alias("origin"))
    return capture.session_states(items).select("session", "items", "last_index")


@query(
    """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
SELECT a.vec_id AS candidate_id, round(COALESCE(MAX(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e))), 0), 6) AS similarity FROM v a LEFT JOIN v b ON a.label = b.label AND b.vec_id % 50 <> 0 WHERE a.vec_id % 50 = 0 GROUP BY 1"""
)
def greatest_similarities(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("candidate_id"), "label", "embedding")
    found = capture.greatest_similarity(e.where("candidate_id % 50 = 0"), e.where("candidate_id % 50 <> 0"), "label")
    return found.select("candidate_id", F.round("similarity", 6).alias("similarity"))


@query(
    with_views(MEMORIES, CHUNKS)
    + """, p AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'team alpha' END AS raw FROM memories) SELECT 'parent' AS level, id, 'team alpha' AS project FROM p WHERE id % 3 = 0 UNION ALL SELECT 'chunk', c.id, 'team alpha' FROM chunks c JOIN p ON p.id = c.parent_id WHERE p.id % 3 = 0"""
)
def project_backfill(spark, d):
    parents = v.memories(spark, d).withColumn("project", F.lit(None).cast("string"))
    tag = F.when(F.col("id") % 3 == 0, project_tag(F.lit("team alpha")))
    up, down = capture.project_backfill(parents, v.chunks(spark, d), tag)
    return up.select(F.lit("parent").alias("level"), "id", "project").unionByName(down.select(F.lit("chunk").alias("level"), "id", "project"))


NAMES = """names AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'bundle-' || strftime(o_orderdate, '%Y%m%d') || 'T010203Z.tar.gpg' WHEN 1 THEN 'dump_' || strftime(o_orderdate, '%Y%m%d') || '_040506.sql.gpg' WHEN 2 THEN 'old/bundle-20240101T000000Z.tar.gpg' ELSE 'notes.txt' END AS name, o_orderdate AS modified_at, o_orderkey % 8 = 0 AS kept FROM orders)"""


def _names(spark, d):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyyMMdd")
    name = F.when(k % 4 == 0, F.concat(F.lit("bundle-"), day, F.lit("T010203Z.tar.gpg"))).when(k % 4 == 1, F.concat(F.lit("dump_"), day, F.lit("_040506.sql.gpg"))).when(k % 4 == 2, "old/bundle-20240101T000000Z.tar.gpg").otherwise("notes.txt")
    return read(spark, d, "orders").select(name.alias("name"), F.col("o_orderdate").cast("timestamp_ntz").alias("modified_at"), (k % 8 == 0).alias("kept"))


@query(
    with_views(NAMES)
    + """, b AS (SELECT name, CASE WHEN name LIKE 'bundle%' THEN 'bundle' ELSE 'dump' END AS kind, CASE WHEN name LIKE 'bundle%' THEN strptime(substr(name, 8, 15), '%Y%m%dT%H%M%S') ELSE strptime(substr(name, 6, 15), '%Y%m%d_%H%M%S') END AS made FROM names WHERE name LIKE 'bundle-%' OR name LIKE 'dump%'),
m AS (SELECT * FROM b ORDER BY made DESC, name DESC LIMIT 1) SELECT true AS found, name, kind, round(epoch(TIMESTAMP '1998-08-03 00:00:00' - made)::BIGINT / 3600, 2)::DOUBLE AS age_hours, epoch(TIMESTAMP '1998-08-03 00:00:00' - made) / 3600 <= 36 AS fresh, (SELECT COUNT(*) FROM b) AS candidates FROM m"""
)
def latest_backup(spark, d):
    return capture.latest_backup(_names(spark, d), "1998-08-03 00:00:00")


@query(with_views(NAMES) + "SELECT name FROM names WHERE (name LIKE '%.gpg' OR name LIKE '%.receipt.json') AND NOT contains(name, '/') AND NOT kept AND modified_at < TIMESTAMP '1998-08-03' - INTERVAL 365 DAY")
def expired_backups(spark, d):
    return capture.expired_files(_names(spark, d), "1998-08-03 00:00:00", 365)


@query("SELECT event_id AS key, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN true ELSE COALESCE(epoch_us(TIMESTAMP '2024-01-15') - epoch_us(ts) >= 86400000000, true) END AS due FROM events")
def notifications_due(spark, d):
    e = F.col("event_id")
    rows = read(spark, d, "events").select(e.alias("key"), F.when(e % 3 == 0, "never").when(e % 3 == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("last_notified_at"))
    return capture.due(rows, "2024-01-15 00:00:00", 86400)


@query(with_views(MEMORIES, RUNS) + ", l AS (SELECT MAX(completed_at) AS last FROM runs WHERE run_type = 'repair') SELECT last, date_diff('second', last, TIMESTAMP '2024-06-01') >= 86400 AND ((SELECT MAX(created_at) FROM memories) > last OR (SELECT MAX(completed_at) FROM runs) > last) AS due FROM l")
def briefing_due(spark, d):
    return capture.briefing_due(v.runs(spark, d), v.memories(spark, d), "repair", AS_OF)


@query(
    """WITH r AS (SELECT user_id AS key, ts AS seen, event_id AS run, CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 3 = 1 AND event_id % 7 = 0 THEN 0 END AS proof FROM events),
c AS (SELECT *, SUM(1 - proof) OVER (PARTITION BY key ORDER BY seen DESC, run DESC ROWS UNBOUNDED PRECEDING) AS clean FROM r WHERE proof IS NOT NULL)
SELECT key, COUNT(run) FILTER (clean = 0) AS streak FROM (SELECT DISTINCT key FROM r) k LEFT JOIN (SELECT key, run, clean FROM c) USING (key) GROUP BY key"""
)
def miss_streaks(spark, d):
    e = F.col("event_id")
    reports = read(spark, d, "events").select(
        F.col("user_id").alias("key"), F.col("ts").alias("at"), e.alias("run"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("infrastructure_failed"), F.lit(False).alias("spend_incomplete"),
        F.when(e % 3 == 0, 2).otherwise(0).alias("contract_failed"), F.when((e % 3 == 1) & (e % 7 == 0), 1).otherwise(0).alias("processed"),
    )
    return capture.streaks(reports)


@query(
    """WITH o AS (SELECT user_id AS run, event_id, CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'click' THEN 'too_short' ELSE 'timeout' END AS result, event_id % 5 <> 0 AS guarded FROM events WHERE user_id % 2 = 0 OR event_type <> 'purchase'),
b AS (SELECT *, COUNT(*) FILTER (guarded) OVER w >= 3 AND NOT COALESCE(bool_or(CASE WHEN guarded THEN result = 'ok' END) OVER w, false) AS bad FROM o WINDOW w AS (PARTITION BY run)) SELECT run, event_id, result FROM b WHERE NOT (bad AND guarded AND result = 'too_short')"""
)
def recorded_outcomes(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "click", "too_short").otherwise("timeout")
    rows = read(spark, d, "events").where("user_id % 2 = 0 OR event_type <> 'purchase'").select(F.col("user_id").alias("run"), "event_id", kind.alias("result"), (F.col("event_id") % 5 != 0).alias("guarded"))
    return capture.recorded_outcomes(rows).select("run", "event_id", "result")


@query(
    """SELECT event_id FROM events WHERE NOT CASE WHEN event_id % 3 = 0 THEN ts < TIMESTAMP '2024-02-10' - INTERVAL 30 DAY WHEN event_id % 3 = 1 THEN ts < TIMESTAMP '2024-02-10' - INTERVAL 60 DAY ELSE false END"""
)
def pruned_ledger(spark, d):
    e, ts = F.col("event_id"), F.col("ts").cast("timestamp_ntz")
    none = F.lit(None).cast("timestamp_ntz")
    rows = read(spark, d, "events").select("event_id", F.when(e % 3 == 0, ts).otherwise(none).alias("skip_until"), F.when(e % 3 == 1, ts).otherwise(none).alias("last_attempt_at"), none.alias("first_failed_at"))
    return capture.pruned(rows, "2024-02-10 00:00:00").select("event_id")


KINDS = ("started", "user", "user", "user", "user_other", "legacy", "final", "final", "completed", "aborted", "context", "message", "other", "broken")


def _log(spark, d):
    """Events of a user as a task's log: kinds, turns and messages follow from the event's number."""
    i = F.col("event_id")
    h = F.pmod(F.xxhash64("event_id"), F.lit(1_000_003))
    return read(spark, d, "events").select(
        F.col("user_id").cast("string").alias("task"), i.alias("n"), v.pick(KINDS, h).alias("kind"), F.concat(F.lit("t"), F.floor(i / 900).cast("string")).alias("turn"),
        F.when(F.pmod(h, F.lit(29)) != 0, F.concat(F.lit("m"), F.floor(i / 400).cast("string"), F.lit("-"), F.pmod(h, F.lit(5)).cast("string"))).alias("message"),
        F.when(F.pmod(h, F.lit(31)) != 0, F.concat_ws(" ", "event_type", "props")).alias("text"), F.col("ts").alias("at"),
    )


@query()
def assembled_turns(spark, d):
    """Turns of the users' logs and what was dropped, with prompts of the old form; tests hold it against a plain loop."""
    return turns.assembled(_log(spark, d), legacy=True)

"""Queries of selection, batching and listing, and of addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import ledger
from . import views as v
from .ledger_queries import QUOTAS
from .registry import query
from .views import CANDIDATES, MEMORIES, read, with_views


@query(
    with_views(MEMORIES)
    + """, r AS (SELECT id, CASE WHEN type IN ('insight', 'schema') THEN 'generated:' || type ELSE COALESCE(source_type, '') END AS channel, type IN ('insight', 'schema') AS gen, CASE WHEN mem_class <> 'procedural' THEN length(content) // 1000 END AS salience, access_count AS novelty, created_at FROM memories WHERE status = 'active'),
t AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY channel, salience, novelty ORDER BY created_at DESC, id DESC) AS turn, COUNT(*) OVER (PARTITION BY channel, salience, novelty) AS size FROM r WHERE salience IS NOT NULL),
o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY salience DESC, novelty DESC, turn, size DESC, channel) AS place FROM t),
c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY channel ORDER BY place) AS own FROM o), g AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY gen ORDER BY place) AS nth FROM c WHERE own <= 6),
f AS (SELECT channel, id, gen FROM g WHERE NOT gen OR nth <= 5 ORDER BY place LIMIT 20),
l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY channel ORDER BY created_at DESC, id) AS n FROM r WHERE id NOT IN (SELECT id FROM f)),
k AS (SELECT channel, gen, COUNT(*) AS n, 6 - (SELECT COUNT(*) FROM f WHERE f.channel = l.channel) AS room FROM l GROUP BY 1, 2),
p AS (SELECT 0 AS part, channel, n, room, 40 - (SELECT COUNT(*) FROM f) AS total FROM k WHERE NOT gen), pq AS ("""
    + QUOTAS.format(t="p")
    + """), s AS (SELECT 0 AS part, channel, n, room, LEAST(5 - (SELECT COUNT(*) FROM f WHERE gen), 40 - (SELECT COUNT(*) FROM f) - (SELECT COALESCE(SUM(quota), 0) FROM pq))::BIGINT AS total FROM k WHERE gen), sq AS ("""
    + QUOTAS.format(t="s")
    + """)
SELECT channel, id, 'salience' AS why FROM f UNION ALL SELECT l.channel, id, 'share' FROM l JOIN (SELECT * FROM pq UNION ALL SELECT * FROM sq) q ON q.channel = l.channel WHERE n <= quota"""
)
def arrival_selection(spark, d):
    own = F.col("type").isin("insight", "schema")
    channel = F.when(own, F.concat(F.lit("generated:"), "type")).otherwise(F.col("source_type"))
    lengths = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.floor(F.length("text") / 1000).alias("_length"))  # before any shuffle
    salience = F.when(F.col("mem_class") != "procedural", F.col("_length"))
    rows = v.memories(spark, d).where("status = 'active'").join(lengths, "id").select("id", channel.alias("channel"), own.alias("generated"), salience.alias("salience"), F.col("access_count").alias("novelty"), "created_at")
    return ledger.select_arrivals(rows, 40, 6, 5)


@query(
    """WITH t AS (SELECT conv_id AS key, turn, length(text) AS characters FROM conversations),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY key ORDER BY turn) AS n, SUM(characters) OVER (PARTITION BY key ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM t)
SELECT key, turn, n = 1 OR (n <= 4 AND running <= 1500) AS in_batch FROM r"""
)
def turn_batches(spark, d):
    turns = read(spark, d, "conversations").select(F.col("conv_id").alias("key"), "turn", F.length("text").alias("characters"))
    return ledger.batches(turns, 4, 1500)


@query(
    with_views(MEMORIES)
    + "SELECT source_type, string_agg('- ' || id || ' ' || type || ' (' || project || ')', E'\\n' ORDER BY created_at, id) AS text FROM memories WHERE type IN ('decision', 'insight') GROUP BY 1"
)
def inventory_manifest(spark, d):
    line = F.concat(F.lit("- "), F.col("id").cast("string"), F.lit(" "), "type", F.lit(" ("), "project", F.lit(")"))
    return ledger.manifest(v.memories(spark, d).where("type IN ('decision', 'insight')"), "source_type", line, ["created_at", "id"])


@query(
    with_views(CANDIDATES)
    + """, i AS (SELECT run_id, position, MIN(strategy) = 'bridge' AS guaranteed, MIN(score) AS share FROM candidates GROUP BY 1, 2)
SELECT run_id, position, guaranteed, share, (ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY guaranteed DESC, share DESC, position))::INTEGER AS place FROM i"""
)
def judging_order(spark, d):
    items = v.candidates(spark, d).groupBy("run_id", "position").agg((F.min("strategy") == "bridge").alias("guaranteed"), F.min("score").alias("share"))
    return ledger.judging_order(items)


@query(with_views(MEMORIES) + "SELECT DISTINCT type, created_at::DATE AS day FROM memories WHERE status = 'active'")
def output_days(spark, d):
    return v.memories(spark, d).where("status = 'active'").select("type", F.col("created_at").cast("date").alias("day")).distinct()


@query("SELECT conv_id, COUNT(*) AS turns FROM conversations WHERE role = 'user' GROUP BY conv_id HAVING COUNT(*) = 3")
def capped_sessions(spark, d):
    return read(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("turns")).where("turns = 3")


@query(with_views(MEMORIES) + "SELECT id, url FROM memories WHERE starts_with(url, 'https://h1.') OR starts_with(url, 'https://h7.example.com/d/1')")
def rows_by_prefix(spark, d):
    return v.memories(spark, d).where(urls.any_prefix(F.col("url"), ["https://h1.", "https://h7.example.com/d/1"])).select("id", "url")


@query(
    """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://a.example.com:8080/x?Q=1' WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN url ELSE NULL END AS strict, page_id % 5 = 4 AS private FROM pages"""
)
def strict_addresses(spark, d):
    k = F.pmod("page_id", F.lit(5))
    url = F.when(k == 0, "HTTPS://A.example.com:08080/x?Q=1").when(k == 1, "https://me@a.example.com/").when(k == 2, "https://a\\b.example.com/").when(k == 3, F.col("url")).otherwise("http://0x7f.1/")
    rows = read(spark, d, "pages").select("page_id", url.alias("u"))
    host = F.regexp_extract("u", r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return rows.select("page_id", urls.strict_url(F.col("u")).alias("strict"), urls.private_host(host).alias("private"))

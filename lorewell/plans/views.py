"""The corpus model over the given tables, as DataFrames and as SQL common table expressions of the same name.

Every column is an expression of the tables, so that queries can be repeated by SQL. Times are fixed, never now().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("learning", "decision", "pattern", "reference", "insight", "conversation", "schema")
RELATIONS = ("supports", "contradicts", "extends", "supersedes", "relates_to", "derived_from", "schema_contains")
CLASSES = ("semantic", "episodic", "procedural")
VERDICTS = ("accept", "reject", "revise")
EPOCH = "2024-01-01 00:00:00"
AS_OF = "2024-06-01 00:00:00"
#: Longest chunk, in characters.
CHUNK = 4000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def _pick(values: tuple[str, ...], index: str) -> str:
    return f"[{', '.join(map(repr, values))}][({index}) % {len(values)} + 1]"


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as corpus rows without a parent."""
    i = F.col("doc_id")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    return (
        read(spark, sf_dir, "documents")
        .join(labels, "doc_id", "left")
        .select(
            i.alias("id"),
            pick(TYPES, i).alias("type"),
            F.substring(F.substring_index("text", ".", 1), 1, 80).alias("title"),
            F.col("text").alias("content"),
            F.col("source").alias("source_type"),
            F.col("lang").alias("project"),
            F.when(F.col("toxic") == 1, "superseded").otherwise("active").alias("status"),
            pick(CLASSES, i).alias("mem_class"),
            (F.pmod(i, F.lit(101)) / 100.0).alias("confidence"),
            F.pmod(i, F.lit(11)).alias("access_count"),
            F.array(F.concat(F.lit("t"), F.pmod(i, F.lit(7)).cast("string")), F.concat(F.lit("u"), F.pmod(i, F.lit(5)).cast("string"))).alias("tags"),
            F.concat(F.lit("https://h"), F.pmod(i, F.lit(13)).cast("string"), F.lit(".example.com/d/"), i.cast("string")).alias("url"),
            (F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(hours=i.cast("int"))).alias("created_at"),
        )
    )


MEMORIES = f"""memories AS (
  SELECT d.doc_id AS id, {_pick(TYPES, 'd.doc_id')} AS type, substr(split_part(text, '.', 1), 1, 80) AS title, text AS content, source AS source_type, lang AS project,
    CASE WHEN toxic = 1 THEN 'superseded' ELSE 'active' END AS status, {_pick(CLASSES, 'd.doc_id')} AS mem_class, (d.doc_id % 101) / 100.0::DOUBLE AS confidence, d.doc_id % 11 AS access_count,
    ['t' || (d.doc_id % 7), 'u' || (d.doc_id % 5)] AS tags, 'https://h' || (d.doc_id % 13) || '.example.com/d/' || d.doc_id AS url, TIMESTAMP '{EPOCH}' + to_hours(d.doc_id::INTEGER) AS created_at
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of long documents: fixed runs of CHUNK characters, those of every seventh document superseded."""
    d = read(spark, sf_dir, "documents").where(F.length("text") > CHUNK)
    n = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / CHUNK).cast("int")))
    return d.select("doc_id", "text", "source", "lang", n.alias("chunk_index")).select(
        (F.lit(1_000_000_000) + F.col("doc_id") * 1000 + F.col("chunk_index")).cast("long").alias("id"),
        F.col("doc_id").alias("parent_id"),
        "chunk_index",
        F.expr(f"substring(text, chunk_index * {CHUNK} + 1, {CHUNK})").alias("content"),
        F.col("source").alias("source_type"),
        F.col("lang").alias("project"),
        F.when(F.pmod("doc_id", F.lit(7)) == 0, "superseded").otherwise("active").alias("status"),
    )


CHUNKS = f"""chunks AS (
  SELECT 1000000000 + doc_id * 1000 + n AS id, doc_id AS parent_id, n::INTEGER AS chunk_index, substr(text, n * {CHUNK} + 1, {CHUNK}) AS content, source AS source_type, lang AS project,
    CASE WHEN doc_id % 7 = 0 THEN 'superseded' ELSE 'active' END AS status
  FROM (SELECT *, unnest(range(0, (length(text) - 1) // {CHUNK} + 1)) AS n FROM documents WHERE length(text) > {CHUNK}))"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges between documents, from order lines; the hash spreads both ends over all documents."""
    n = read(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    return (
        read(spark, sf_dir, "lineitem")
        .join(F.broadcast(n))
        .select(
            F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber"), F.col("n")).alias("source_id"),
            F.pmod(F.col("l_partkey") * 13 + F.col("l_linenumber"), F.col("n")).alias("target_id"),
            pick(RELATIONS, F.col("l_orderkey") + F.col("l_linenumber")).alias("relation"),
            F.when(F.col("l_quantity") > 25, F.concat(F.lit("q"), F.col("l_quantity").cast("int").cast("string"))).alias("note"),
            F.col("l_shipdate").alias("created_at"),
            F.when(F.col("l_returnflag") == "R", F.col("l_shipdate") + F.expr("INTERVAL 90 DAYS")).alias("expired_at"),
        )
        .where("source_id <> target_id")
    )


EDGES = f"""edges AS (
  SELECT * FROM (
    SELECT (l_orderkey * 7 + l_linenumber) % n AS source_id, (l_partkey * 13 + l_linenumber) % n AS target_id, {_pick(RELATIONS, 'l_orderkey + l_linenumber')} AS relation,
      CASE WHEN l_quantity > 25 THEN 'q' || l_quantity::INTEGER END AS note, l_shipdate AS created_at, CASE WHEN l_returnflag = 'R' THEN l_shipdate + INTERVAL 90 DAY END AS expired_at
    FROM lineitem, (SELECT COUNT(*) AS n FROM documents)) WHERE source_id <> target_id)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs; an open order's run has not completed."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        pick(("discovery", "skim", "repair"), F.col("o_custkey")).alias("run_type"),
        F.col("o_orderdate").alias("started_at"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR")).alias("completed_at"),
        F.pmod("o_orderkey", F.lit(4)).alias("generated"),
        F.col("o_totalprice").alias("cost"),
    )


RUNS = """runs AS (
  SELECT o_orderkey AS run_id, ['discovery', 'skim', 'repair'][o_custkey % 3 + 1] AS run_type, o_orderdate AS started_at, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 1 HOUR END AS completed_at,
    o_orderkey % 4 AS generated, o_totalprice AS cost FROM orders)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as candidates with four seats' verdicts."""
    o, p, s, q = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("int")
    n = read(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    return (
        read(spark, sf_dir, "lineitem")
        .join(F.broadcast(n))
        .select(
            o.alias("run_id"),
            F.col("l_linenumber").alias("position"),
            pick(("bridge", "gap", "tension", "trend", "outlier", "revisit"), s).alias("strategy"),
            pick(VERDICTS, p).alias("seat_a"),
            pick(VERDICTS, s).alias("seat_b"),
            pick(VERDICTS, q).alias("seat_c"),
            pick(VERDICTS, p + s).alias("seat_d"),
            F.col("l_discount").alias("score"),
            F.array_distinct(F.array(F.pmod(p, F.col("n")), F.pmod(p * 3 + s, F.col("n")), F.pmod(s * 5 + q, F.col("n")))).alias("source_ids"),
            F.when(F.pmod(p, F.lit(3)) == 0, F.pmod(p * 11 + q, F.col("n"))).alias("memory_id"),
            F.when(F.col("l_discount") >= 0.1, F.col("l_shipdate")).alias("user_rejected_at"),
            F.when(F.col("l_discount") >= 0.1, pick(("obvious", "wrong", "stale"), s)).alias("reason"),
        )
    )


CANDIDATES = f"""candidates AS (
  SELECT l_orderkey AS run_id, l_linenumber AS position, ['bridge', 'gap', 'tension', 'trend', 'outlier', 'revisit'][l_suppkey % 6 + 1] AS strategy,
    {_pick(VERDICTS, 'l_partkey')} AS seat_a, {_pick(VERDICTS, 'l_suppkey')} AS seat_b, {_pick(VERDICTS, 'l_quantity::INTEGER')} AS seat_c, {_pick(VERDICTS, 'l_partkey + l_suppkey')} AS seat_d,
    l_discount AS score, list_distinct([l_partkey % n, (l_partkey * 3 + l_suppkey) % n, (l_suppkey * 5 + l_quantity::INTEGER) % n]) AS source_ids,
    CASE WHEN l_partkey % 3 = 0 THEN (l_partkey * 11 + l_quantity::INTEGER) % n END AS memory_id, CASE WHEN l_discount >= 0.1 THEN l_shipdate END AS user_rejected_at,
    CASE WHEN l_discount >= 0.1 THEN ['obvious', 'wrong', 'stale'][l_suppkey % 3 + 1] END AS reason
  FROM lineitem, (SELECT COUNT(*) AS n FROM documents))"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"

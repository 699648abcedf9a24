"""Queries of retrieval and of its quality. The query set is the benchmark table and every 50th vector."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation, retrieval, term_index, vector_index, vectors
from ..sources.shared import cut, fingerprint, shared_dir
from . import views as v
from .registry import query
from .views import AS_OF, CHUNKS, EDGES, MEMORIES, read, with_views

WORDS = r"""list_filter(regexp_split_to_array(lower(regexp_replace({}, '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g')), '\s+'), lambda t: t <> '')"""
VECTORS = """v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"""
NEAREST = """nearest AS (SELECT query_id, id, round(similarity, 9) AS similarity, (ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY similarity DESC, id))::INTEGER AS rank
  FROM (SELECT a.id AS query_id, b.id, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) AS similarity FROM v a, v b WHERE a.id % 50 = 0))"""
#: Rows that a search is over: documents with what they answer, and their chunks.
ROWS = f"""rows AS (
  SELECT id, NULL::BIGINT AS parent_id, type, title, CASE WHEN id % 9 = 0 THEN 'Questions this answers: which' || chr(10) || '- ' || title || chr(10) || '* ' || project || chr(10) || content ELSE content END AS content,
    source_type, project, status, mem_class, access_count, confidence AS depth, CASE WHEN id % 2 = 0 THEN source_type || ' ' || title END AS encoding_context, created_at, CASE WHEN id % 4 = 0 THEN created_at + to_days((id % 23)::INTEGER) END AS last_accessed_at FROM memories
  UNION ALL SELECT id, parent_id, 'reference', NULL, content, source_type, project, status, 'source', 0, 0.0, NULL, NULL, NULL FROM chunks)"""
PART = r"(?i)(?:^|\n)questions this answers:([^\n]*)\n?((?:[-*] [^\n]*(?:\n|$))*)"
LEXICAL = f"""terms AS (SELECT item_id AS query_id, unnest(ts) AS term, len(ts)::INTEGER AS terms FROM (SELECT item_id, list_distinct({WORDS.format('text')}) AS ts FROM benchmark)),
own AS (SELECT id, content, concat_ws(' ', title, regexp_extract(content, '{PART}', 1), regexp_extract(content, '{PART}', 2)) AS a, replace(content, regexp_extract(content, '{PART}', 2), '') AS b FROM rows r
  WHERE NOT (parent_id IS NOT NULL AND status = 'superseded') AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.parent_id = r.id AND c.status = 'active')),
places AS (SELECT id, unnest({WORDS.format('a')}) AS term, 1.0::DOUBLE AS w FROM own UNION ALL SELECT id, unnest({WORDS.format('b')}), 0.4::DOUBLE FROM own),
counts AS (SELECT id, term, SUM(w) AS weight FROM places WHERE term IN (SELECT term FROM terms) GROUP BY 1, 2),
common AS (SELECT term, COUNT(*) / (SELECT COUNT(*) FROM rows) AS frequency FROM counts GROUP BY term HAVING COUNT(*) / (SELECT COUNT(*) FROM rows) > 0.05),
hits AS (SELECT query_id, c.id, MAX(terms) AS terms, COUNT(*) AS met, COUNT(*) FILTER (rare) AS rare, SUM(weight) AS aw, SUM(weight) FILTER (rare) AS rw
  FROM (SELECT *, terms = 1 OR term NOT IN (SELECT term FROM common) AS rare FROM terms) t JOIN counts c USING (term) GROUP BY 1, 2),
scored AS (SELECT query_id, h.id, CASE WHEN met = terms THEN 1 ELSE 2 END AS pass, CASE WHEN met = terms THEN aw ELSE rw END / (1 + ln(GREATEST(length(content), 1))) AS x FROM hits h JOIN own m ON m.id = h.id WHERE met = terms OR rare > 0),
lexical AS (SELECT * FROM (SELECT query_id, id, pass, round(x / (1 + x), 9) AS score, (ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY pass, round(x / (1 + x), 9) DESC, id))::INTEGER AS rank FROM scored) WHERE rank <= 40)"""
#: The vector of a benchmark query is that of the row with the same number.
VECTOR = """vector AS (SELECT query_id, id, rank FROM (SELECT a.id AS query_id, b.id, (ROW_NUMBER() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) DESC, b.id))::INTEGER AS rank
  FROM v a, v b WHERE a.id IN (SELECT item_id FROM benchmark)) WHERE rank <= 40)"""
FUSED = """fused AS (SELECT query_id, id, 1.0::DOUBLE / (60 + COALESCE(b.rank, 41)) + 1.0::DOUBLE / (60 + COALESCE(a.rank, 41)) AS rrf FROM lexical a FULL JOIN vector b USING (query_id, id))"""


def _vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _queries(spark, d):
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _rows(spark, d):
    """Documents, every ninth with a section of what it answers, and their chunks, as rows of a search."""
    i, null = F.col("id"), F.lit(None)
    own = F.concat(F.lit("Questions this answers: which\n- "), "title", F.lit("\n* "), "project", F.lit("\n"), "content")
    accessed = F.col("created_at") + F.make_dt_interval(days=F.pmod(i, F.lit(23)).cast("int"))
    parents = v.memories(spark, d).select(
        "id", null.cast("long").alias("parent_id"), "type", "title", F.when(F.pmod(i, F.lit(9)) == 0, own).otherwise(F.col("content")).alias("content"), "source_type", "project", "status", "mem_class",
        F.col("access_count").cast("long").alias("access_count"), F.col("confidence").alias("depth"), F.when(F.pmod(i, F.lit(2)) == 0, F.concat_ws(" ", "source_type", "title")).alias("encoding_context"), "created_at", F.when(F.pmod(i, F.lit(4)) == 0, accessed).alias("last_accessed_at"),
    )
    none = {"title": "string", "encoding_context": "string", "created_at": "timestamp_ntz", "last_accessed_at": "timestamp_ntz"}
    filled = {"type": F.lit("reference"), "mem_class": F.lit("source"), "access_count": F.lit(0).cast("long"), "depth": F.lit(0.0)} | {c: null.cast(t) for c, t in none.items()}
    return parents.unionByName(v.chunks(spark, d).drop("chunk_index").withColumns(filled))


def _index(spark, d):
    """The rows' kept table of terms, made by the first query that needs it; other files of the tables have another."""
    made_of = fingerprint(read(spark, d, "documents"), read(spark, d, "labels"))
    return term_index.kept(f"{shared_dir(spark)}/terms-{made_of}", _rows(spark, d))


def _lexical(spark, d):
    return _index(spark, d).lexical_leg(_queries(spark, d), retrieval.PREFETCH)


def _vector(spark, d):
    rows = _vectors(spark, d)
    asked = _queries(spark, d).join(rows, F.col("query_id") == F.col("id")).select("query_id", "embedding")
    return vectors.top_k(asked, rows, 40)


@query(with_views(VECTORS, NEAREST) + "SELECT * FROM nearest WHERE rank <= 10")
def vector_top_k(spark, d):
    rows = _vectors(spark, d)
    asked = rows.where(F.pmod("id", F.lit(50)) == 0).withColumnRenamed("id", "query_id")
    return vectors.top_k(asked, rows, 10).withColumn("similarity", F.round("similarity", 9))


@query(with_views(VECTORS, NEAREST) + "SELECT query_id, arg_max(id, (similarity, -id)) AS nearest, round(MAX(similarity), 6) AS similarity FROM nearest WHERE id <> query_id GROUP BY query_id HAVING MAX(similarity) > 0.4")
def near_duplicate_test(spark, d):
    rows = _vectors(spark, d)
    asked = rows.where(F.pmod("id", F.lit(50)) == 0).withColumnRenamed("id", "query_id")
    return vectors.top_k(asked, rows, 1, exclude_self=True).where("similarity > 0.4").select("query_id", F.col("id").alias("nearest"), F.round("similarity", 6).alias("similarity"))


@query(with_views(MEMORIES, CHUNKS, ROWS, LEXICAL) + "SELECT * FROM lexical")
def lexical_leg(spark, d):
    return _lexical(spark, d)


@query(with_views(MEMORIES, CHUNKS, ROWS, LEXICAL) + "SELECT term, round(frequency, 9) AS frequency FROM common")
def common_terms(spark, d):
    index = _index(spark, d)
    counts = index.weights(retrieval.query_terms(_queries(spark, d)), retrieval.lexical_rows(index.docs))
    return retrieval.common_terms(counts, index.docs.count()).select("term", F.round("frequency", 9).alias("frequency"))


@query(
    with_views(MEMORIES, CHUNKS, ROWS, VECTORS, LEXICAL, VECTOR, FUSED)
    + """SELECT query_id, id, round(rrf, 9) AS rrf, round(CASE WHEN MAX(rrf) OVER w > MIN(rrf) OVER w THEN (rrf - MIN(rrf) OVER w) / (MAX(rrf) OVER w - MIN(rrf) OVER w) ELSE 1.0 END, 6) AS normalised FROM fused WINDOW w AS (PARTITION BY query_id)"""
)
def rrf_hybrid(spark, d):
    fused = retrieval.fuse(_lexical(spark, d), _vector(spark, d), 41)
    return fused.select("query_id", "id", F.round("rrf", 9).alias("rrf"), F.round("normalised", 6).alias("normalised"))


def _pool(spark, d):
    """Every benchmark query against the rows its legs found."""
    return cut(retrieval.fuse(_lexical(spark, d), _vector(spark, d), 41), "pool")


def _asked(spark, d):
    return _queries(spark, d).withColumn("query_project", F.lit("en"))


def _reranked(spark, d):
    return retrieval.rerank(_pool(spark, d), _rows(spark, d), _asked(spark, d), AS_OF, index=_index(spark, d))


OVERLAP = """(SELECT COUNT(*) FROM unnest({q}) x(t) WHERE list_contains({d}, t) OR (length(t) >= 4 AND len(list_filter({d}, lambda y: starts_with(y, t))) > 0) OR len(list_filter({d}, lambda y: length(y) >= 4 AND starts_with(t, y))) > 0) / len({q})"""
SIGNALS = f"""pool AS (SELECT query_id, id, CASE WHEN MAX(rrf) OVER w > MIN(rrf) OVER w THEN (rrf - MIN(rrf) OVER w) / (MAX(rrf) OVER w - MIN(rrf) OVER w) ELSE 1.0 END AS normalised FROM fused WINDOW w AS (PARTITION BY query_id)),
wide AS (SELECT p.query_id, p.id, normalised, m.type, m.mem_class, m.project, m.status, m.depth, m.access_count, m.created_at, list_distinct({WORDS.format('m.content')}) AS dw, list_distinct({WORDS.format("coalesce(m.title, '')")}) AS tw,
  list_distinct({WORDS.format("coalesce(m.encoding_context, '')")}) AS cw, list_distinct({WORDS.format('b.text')}) AS qw, GREATEST(0.0, epoch(TIMESTAMP '{AS_OF}' - m.created_at) / 86400.0)::DOUBLE AS age,
  CASE WHEN m.last_accessed_at IS NULL THEN 1.0 ELSE LEAST(1.0, GREATEST(0.0, epoch(TIMESTAMP '{AS_OF}' - m.last_accessed_at) / 86400.0) / 7.0) END::DOUBLE AS spacing FROM pool p JOIN rows m USING (id) JOIN benchmark b ON b.item_id = p.query_id),
signals AS (SELECT *, {OVERLAP.format(q='qw', d='list_concat(dw, tw)')} AS overlap, {OVERLAP.format(q='qw', d='tw')} AS title_overlap, {OVERLAP.format(q='qw', d='cw')} AS context_overlap,
  CASE WHEN created_at IS NULL THEN 0.35 ELSE pow(1 + age / (30 + 10 * ln(1 + access_count)), -0.8) END AS recency, LEAST(1.0, len(dw) / 80.0) AS len_score, 0.03 * ln(1 + access_count) * spacing AS reinforcement,
  CASE WHEN type IN ('idea', 'synthesis', 'insight', 'decision') THEN 0.06 ELSE 0 END + CASE mem_class WHEN 'semantic' THEN 0.04 WHEN 'procedural' THEN 0.02 ELSE 0 END AS boost,
  CASE WHEN project <> 'en' THEN -0.15 ELSE 0 END + CASE WHEN status = 'superseded' THEN -0.2 ELSE 0 END + CASE WHEN created_at IS NOT NULL AND access_count = 0 AND age > 90 THEN -0.05 * LEAST(1.0, (age - 90) / 180) ELSE 0 END AS penalty FROM wide),
reranked AS (SELECT query_id, id, overlap, title_overlap, recency, round((normalised * 0.30 + overlap * 0.18 + title_overlap * 0.18 + context_overlap * 0.10 + recency * 0.12 + len_score * 0.08 + depth * 0.05 + reinforcement + boost + penalty)::DOUBLE, 6) AS score FROM signals),
final AS (SELECT query_id, id, score AS rerank_score, round(overlap, 6) AS overlap, round(recency, 6) AS recency, (ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INTEGER AS final_rank FROM reranked)"""
RANKED = (MEMORIES, CHUNKS, ROWS, VECTORS, LEXICAL, VECTOR, FUSED, SIGNALS)


@query(with_views(*RANKED) + "SELECT query_id, id, rerank_score, overlap, recency, final_rank FROM final")
def rerank_scores(spark, d):
    return _reranked(spark, d).select("query_id", "id", "rerank_score", F.round("overlap", 6).alias("overlap"), F.round("recency", 6).alias("recency"), "final_rank")


#: The rows after three updates: some texts changed, some rows gone, some new.
UPDATED = f"""updated AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'Changed twice. ' || content WHEN id % 7 = 0 THEN content || ' and once more' ELSE content END AS content, parent_id, status FROM rows WHERE id % 11 <> 3),
uterms AS (SELECT unnest({WORDS.format("content")}) AS term, id FROM updated UNION ALL SELECT unnest({WORDS.format(f"regexp_extract(content, '{PART}', 1)")}), id FROM updated)"""


@query(with_views(MEMORIES, CHUNKS, ROWS, UPDATED) + "SELECT term, COUNT(DISTINCT id) AS n_rows, COUNT(*) AS places FROM uterms GROUP BY term HAVING COUNT(DISTINCT id) > 20")
def index_after_updates(spark, d):
    """Rows and places of the frequent terms of texts, from an index that was made of half the rows and updated three times;
    what stands on the line of a heading of questions has a place there and one in the text."""
    rows, i = _rows(spark, d), F.col("id")
    path = f"{shared_dir(spark)}/updated-terms-{uuid.uuid4().hex}"
    plain = rows.withColumn("title", F.lit(None).cast("string")).withColumn("encoding_context", F.lit(None).cast("string"))
    once = plain.withColumn("content", F.when(i % 5 == 0, F.concat(F.lit("Changed. "), "content")).otherwise(F.col("content")))
    last = plain.withColumn("content", F.when(i % 5 == 0, F.concat(F.lit("Changed twice. "), "content")).when(i % 7 == 0, F.concat("content", F.lit(" and once more"))).otherwise(F.col("content")))
    for state in (plain.where(i % 2 == 0), once, once.where(i % 11 != 3), last.where(i % 11 != 3)):
        index = term_index.update(path, state)
    live = index.postings.join(index.docs.select("id", "segment"), ["id", "segment"], "left_semi")
    return live.groupBy("term").agg(F.countDistinct("id").alias("n_rows"), F.sum("n").alias("places")).where("n_rows > 20")


@query()
def hybrid_parent_cap(spark, d):
    """The ten best fused rows of each query, one a parent and no twin content; tests hold it against a plain loop."""
    wide = _pool(spark, d).join(_rows(spark, d).select("id", "parent_id", "project", "content"), "id")
    return retrieval.cap_per_parent(wide.withColumn("score", F.col("normalised")), 10, 1)


@query()
def memory_search(spark, d):
    return _search(spark, d)


def _search(spark, d, **filters):
    rows = _vectors(spark, d)
    asked = _queries(spark, d).join(rows, F.col("query_id") == F.col("id"), "left").select("query_id", "text", "embedding", F.lit("en").alias("query_project"))
    return retrieval.search(asked, _rows(spark, d), rows, AS_OF, index=_index(spark, d), **filters)


@query()
def memory_search_of_project(spark, d):
    """The same within a project and a status; tests hold it against a plain loop."""
    return _search(spark, d, project="en", status="active")


@query()
def search_context(spark, d):
    """What a search shows beside its hits; tests hold it against a plain loop."""
    return retrieval.around(_search(spark, d), _rows(spark, d), v.edges(spark, d))


@query()
def learned_topics(spark, d):
    """The three best rows of each topic: the first words of benchmark queries in twos; tests hold it against a plain loop."""
    words = F.slice(F.array_distinct(retrieval.tokens(F.col("text"))), 1, 6)
    topics = _queries(spark, d).withColumn("w", words).select("query_id", F.posexplode(F.array(F.slice("w", 1, 2), F.slice("w", 3, 2), F.slice("w", 5, 2))).alias("n", "t")).where(F.size("t") > 0)
    topics = topics.select("query_id", F.concat_ws(" ", "t").alias("topic")).distinct().join(_vectors(spark, d), F.col("query_id") == F.col("id"), "left").drop("id")
    return retrieval.learn(topics.withColumn("text", F.col("topic")), _rows(spark, d), _vectors(spark, d), AS_OF, index=_index(spark, d))


@query(with_views(*RANKED) + "SELECT f.query_id, f.id, m.title, substr(m.content, 1, 500) AS preview, round(rerank_score, 3) AS shown_score FROM final f JOIN rows m USING (id) WHERE final_rank <= 5")
def shown_results(spark, d):
    hits = _reranked(spark, d).where("final_rank <= 5").select("query_id", "id", "rerank_score")
    return retrieval.shown(hits, _rows(spark, d)).select("query_id", "id", "title", "preview", "shown_score")


@query(
    with_views(*RANKED)
    + """SELECT query_id, id, round((normalised * 0.5 + overlap * 0.18 + title_overlap * 0.18 + context_overlap * 0.10 + recency * 0.12 + len_score * 0.08 + depth * 0.05 + 0.03 * ln(1 + access_count) * 0.5 + boost + penalty - CASE WHEN type IN ('idea', 'synthesis', 'insight', 'decision') THEN 0.06 ELSE 0 END)::DOUBLE, 6) AS score FROM signals"""
)
def rerank_overrides(spark, d):
    again = retrieval.score({"rrf": 0.5}, {"type_boost": 0.0}, 0.5)
    return retrieval.signals(_pool(spark, d), _rows(spark, d), _asked(spark, d), AS_OF, _index(spark, d)).select("query_id", "id", F.round(again, 6).alias("score"))


#: A row is expected for a query if it holds the query's text.
EXPECTED = "expected AS (SELECT b.item_id AS query_id, d.doc_id AS id, 'c' || (b.item_id % 4) AS category FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
PLACED = "placed AS (SELECT q.query_id, q.category, MIN({r}) AS rank FROM (SELECT DISTINCT query_id, category FROM expected) q LEFT JOIN ({t}) f ON f.query_id = q.query_id AND f.id IN (SELECT e.id FROM expected e WHERE e.query_id = q.query_id) GROUP BY 1, 2)"
QUALITY = "COUNT(*) AS queries, COUNT(rank) AS found, round(SUM(COALESCE(1.0::DOUBLE / rank, 0)) / COUNT(*), 6) AS mrr, round(COUNT(*) FILTER (rank <= 1) / COUNT(*), 6) AS hit_1, round(COUNT(*) FILTER (rank <= 3) / COUNT(*), 6) AS hit_3, round(COUNT(*) FILTER (rank <= 5) / COUNT(*), 6) AS hit_5, round(COUNT(*) FILTER (rank <= 10) / COUNT(*), 6) AS hit_10"


def _expected(spark, d):
    """Benchmark passages against whole texts: candidates have the passage's longest word in the index, then the passage is
    looked for; written once, as several steps read it."""
    q = _queries(spark, d)
    longest = F.element_at(F.sort_array(F.transform(F.array_distinct(retrieval.tokens(F.col("text"))), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))), False), 1)["t"]
    keyed = q.select("query_id", F.col("text").alias("passage"), longest.alias("term"))
    index = _index(spark, d)
    words = index.weights(keyed.where("term IS NOT NULL"), index.docs.where("parent_id IS NULL"))
    near = words.join(keyed.select("query_id", "term"), "term").select("query_id", F.col("id").alias("doc_id"))
    texts = near.join(read(spark, d, "documents").select("doc_id", "text"), "doc_id").join(keyed.select("query_id", "passage"), "query_id")
    found = texts.where(F.contains("text", "passage")).select("query_id", F.col("doc_id").alias("id"), F.concat(F.lit("c"), F.pmod("query_id", F.lit(4)).cast("string")).alias("category"))
    return cut(found, "expected")


def _found(spark, d):
    return _reranked(spark, d).select("query_id", "id", F.col("final_rank").alias("rank"))


FINAL = PLACED.format(r="final_rank", t="SELECT query_id, id, final_rank FROM final")


@query(with_views(*RANKED, EXPECTED, FINAL) + f"SELECT category, {QUALITY} FROM placed GROUP BY category")
def mrr_hit(spark, d):
    return evaluation.quality(evaluation.ranks(_expected(spark, d), _found(spark, d)), ["category"])


@query(
    with_views(*RANKED, EXPECTED, FINAL.replace("placed", "after"), PLACED.format(r="rank", t="SELECT * FROM lexical").replace("placed", "before"))
    + """SELECT CASE WHEN COALESCE(a.rank, 1000000) < COALESCE(b.rank, 1000000) THEN 'improved' WHEN COALESCE(a.rank, 1000000) > COALESCE(b.rank, 1000000) THEN 'degraded' ELSE 'same' END AS change, COUNT(*) AS n FROM before b JOIN after a USING (query_id) GROUP BY 1"""
)
def cold_warm(spark, d):
    e = _expected(spark, d)
    return evaluation.compare(evaluation.ranks(e, _lexical(spark, d)), evaluation.ranks(e, _found(spark, d)))


LEGS = (("lexical", "SELECT query_id, id, rank FROM lexical"), ("vector", "SELECT query_id, id, rank FROM vector"), ("full", "SELECT query_id, id, final_rank AS rank FROM final"))


@query(
    with_views(*RANKED, EXPECTED, *(PLACED.format(r="rank", t=t).replace("placed", f"p_{n}") for n, t in LEGS))
    + ", c AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS condition, round(SUM(COALESCE(1.0::DOUBLE / rank, 0)) / COUNT(*), 6) AS mrr FROM p_{n}" for n, _ in LEGS)
    + """), x AS (SELECT condition, mrr, round(mrr - (SELECT mrr FROM c WHERE condition = 'full'), 6) AS delta FROM c WHERE condition <> 'full') SELECT *, (ROW_NUMBER() OVER (ORDER BY abs(delta) DESC, condition))::INTEGER AS place FROM x"""
)
def ablation(spark, d):
    e = _expected(spark, d)
    parts = [evaluation.quality(evaluation.ranks(e, rows)).select(F.lit(name).alias("condition"), "mrr") for name, rows in (("lexical", _lexical(spark, d)), ("vector", _vector(spark, d)), ("full", _found(spark, d)))]
    return evaluation.ablation(parts[0].union(parts[1]).union(parts[2]), "full")


@query(
    with_views(*RANKED, EXPECTED)
    + """, w AS (SELECT unnest([0.0, 0.1, 0.25, 0.5, 1.0])::DOUBLE AS weight), r AS (SELECT weight, query_id, id, ROW_NUMBER() OVER (PARTITION BY weight, query_id ORDER BY round(rerank_score + weight * overlap, 9) DESC, id) AS rank FROM final, w),
h AS (SELECT weight, query_id, MIN(rank) AS rank FROM r WHERE (query_id, id) IN (SELECT query_id, id FROM expected) GROUP BY 1, 2)
SELECT weight, round(SUM(1.0::DOUBLE / rank) / (SELECT COUNT(DISTINCT query_id) FROM expected), 6) AS mrr FROM h GROUP BY weight"""
)
def weight_sweep(spark, d):
    scored = rerank_scores(spark, d).select("query_id", "id", F.col("rerank_score").alias("base"), F.col("overlap").alias("extra"))
    weights = spark.createDataFrame([(w,) for w in (0.0, 0.1, 0.25, 0.5, 1.0)], "weight double")
    return evaluation.sweep(scored, weights, _expected(spark, d))


@query(
    with_views(*RANKED)
    + """, i AS (SELECT query_id, id AS memory_id, id - 1 AS source FROM final WHERE id % 2 = 1) SELECT i.query_id, i.memory_id, bool_and(o.final_rank < s.final_rank) AS outranks, round(avg(s.final_rank - o.final_rank), 6) AS gain
FROM i JOIN final o ON o.query_id = i.query_id AND o.id = i.memory_id JOIN final s ON s.query_id = i.query_id AND s.id = i.source GROUP BY 1, 2"""
)
def consolidation(spark, d):
    ranked = _found(spark, d)
    made = ranked.where(F.pmod("id", F.lit(2)) == 1).select("query_id", F.col("id").alias("memory_id"), (F.col("id") - 1).alias("id"))
    return evaluation.consolidation(ranked, made)


@query(
    with_views(MEMORIES, CHUNKS, ROWS, VECTORS, LEXICAL, VECTOR)
    + """SELECT a.query_id, round(COUNT(b.id) / COUNT(*), 6) AS recall FROM (SELECT * FROM vector WHERE rank <= 10) a LEFT JOIN (SELECT * FROM lexical WHERE rank <= 10) b USING (query_id, id) GROUP BY a.query_id"""
)
def leg_overlap(spark, d):
    return evaluation.recall(_vector(spark, d), _lexical(spark, d), 10)


def _vector_index(spark, d):
    """The vectors' kept index, made by the first query that needs it."""
    path = f"{shared_dir(spark)}/vectors-{fingerprint(read(spark, d, 'embeddings'))}"
    found = vector_index.read(spark, path)
    return found if found is not None else vector_index.build(path, read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label"))


def _every_50th(spark, d):
    return _vectors(spark, d).where(F.pmod("id", F.lit(50)) == 0).withColumnRenamed("id", "query_id")


@query()
def recall_at_k(spark, d):
    """Recall of the search by the kept index against the exact one, for every 50th vector, and the share of rows that it
    scored exactly; tests hold both against bounds."""
    rows, asked = _vectors(spark, d), _every_50th(spark, d)
    found = _vector_index(spark, d).search(asked, 10)
    scored = found.groupBy("query_id").agg((F.max("scored") / F.lit(rows.count())).alias("share_scored"))
    return evaluation.recall(vectors.top_k(asked, rows, 10), found, 10).join(scored, "query_id", "left")


@query(with_views(VECTORS.replace("vec_id AS id", "vec_id AS id, label"), NEAREST.replace("WHERE a.id % 50 = 0", "WHERE a.id % 50 = 0 AND a.id <> b.id AND b.label = 3")) + "SELECT * FROM nearest WHERE rank <= 10")
def filtered_nearest(spark, d):
    """The nearest other vectors of one label, from the kept index with the filter inside its lists, all of them asked."""
    found = _vector_index(spark, d).exhaustive().search(_every_50th(spark, d), 10, F.col("label") == 3, exclude_self=True)
    return found.select("query_id", "id", F.round("similarity", 9).alias("similarity"), "rank")


@query(
    with_views(MEMORIES, CHUNKS, ROWS, VECTORS, LEXICAL, VECTOR, FUSED)
    + """, a AS (SELECT query_id, id, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS ra, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY id) AS rb FROM fused),
p AS (SELECT x.query_id, SUM(sign((x.ra - y.ra) * (x.rb - y.rb))) AS s FROM a x JOIN a y ON x.query_id = y.query_id GROUP BY 1), n AS (SELECT query_id, COUNT(*) AS n FROM a GROUP BY 1)
SELECT query_id, CASE WHEN n < 2 THEN 1.0 ELSE round(s / (n * (n - 1)), 6) END::DOUBLE AS tau FROM p JOIN n USING (query_id)"""
)
def order_agreement(spark, d):
    fused = retrieval.fuse(_lexical(spark, d), _vector(spark, d), 41)
    by = lambda *order: Window.partitionBy("query_id").orderBy(*order)
    place = lambda *order: fused.select("query_id", "id", F.row_number().over(by(*order)).alias("rank"))
    return evaluation.kendall_tau(place(F.desc("rrf"), "id"), place("id"))


@query()
def greedy_clusters(spark, d):
    """Vectors of a label in order of their ids, each with the cluster of its nearest seed."""
    rows = read(spark, d, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("vec_id").alias("position"), "embedding")
    return vectors.greedy_clusters(rows, "label", 0.45)

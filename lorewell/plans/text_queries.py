"""Queries of the text functions, over whole texts and whole tables."""

from __future__ import annotations

import html
from html import entities

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import evaluation  # noqa: F401
from ..sources import transcripts
from . import views as v
from .registry import query
from .views import CHUNKS, MEMORIES, read, with_views


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _n(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, {_sql(pattern)}))"


@query(
    f"""SELECT doc_id, round(GREATEST(0.0, LEAST(1.0, LEAST(0.35, {_n('text', text.CAUSAL)} * 0.15) + LEAST(0.20, ({_n('text', '```')} // 2) * 0.15) + CASE WHEN regexp_matches(text, {_sql(text.QUESTIONS)}) THEN 0.25 ELSE 0.0 END
  + LEAST(0.10, {_n('text', '[^ \\t\\n\\x0B\\f\\r]+')} / 1000.0) + LEAST(0.08, {_n('text', text.NUMBERS)} * 0.04) + LEAST(0.08, len(list_distinct(regexp_extract_all(text, {_sql(text.TOOLS)}))) * 0.04) + LEAST(0.08, {_n('text', text.CONNECTIONS)} * 0.04)))::DOUBLE, 6) AS depth FROM documents"""
)
def depth_scores(spark, d):
    return read(spark, d, "documents").select("doc_id", text.depth_score(F.col("text")).alias("depth"))


@query(with_views(MEMORIES) + f"SELECT id, CASE WHEN regexp_matches(content, {_sql(text.PROCEDURAL)}) THEN 'procedural' WHEN type IN {text.SEMANTIC} THEN 'semantic' ELSE 'episodic' END AS mem_class FROM memories")
def memory_classes(spark, d):
    return v.memories(spark, d).select("id", text.classify(F.col("type"), F.col("content")).alias("mem_class"))


RAW = """raw AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '/home/' || lang WHEN 1 THEN '/home/me/' || source || '/' WHEN 2 THEN 'C:\\Work\\' || upper(source) WHEN 3 THEN '  ' WHEN 4 THEN 'a/.git' WHEN 5 THEN md5(source) ELSE ' ' || source || ' ' END AS raw FROM documents)"""


@query(
    with_views(RAW)
    + r"""SELECT doc_id, CASE WHEN doc_id % 7 IN (0, 3, 4, 5) THEN NULL ELSE lower(trim(split_part(replace(rtrim(trim(raw), '/'), '\', '/'), '/', -1))) END AS tag FROM raw"""
)
def project_tags(spark, d):
    s, i = F.col("source"), F.pmod("doc_id", F.lit(7))
    raw = (
        F.when(i == 0, F.concat(F.lit("/home/"), "lang")).when(i == 1, F.concat(F.lit("/home/me/"), s, F.lit("/"))).when(i == 2, F.concat(F.lit("C:\\Work\\"), F.upper(s)))
        .when(i == 3, "  ").when(i == 4, "a/.git").when(i == 5, F.md5(s.cast("binary"))).otherwise(F.concat(F.lit(" "), s, F.lit(" ")))
    )
    return read(spark, d, "documents").select("doc_id", text.project_tag(raw).alias("tag"))


@query("SELECT doc_id, 'Title ' || doc_id AS title, 'https://x.example.com/' || doc_id AS source_url, lang AS doc_type, length(trim(text, E' \\t\\n\\r\\x0B\\f')) AS body_length FROM documents")
def header_fields(spark, d):
    made = F.concat(F.lit("# Title "), F.col("doc_id").cast("string"), F.lit("\n\nSource URL: https://x.example.com/"), F.col("doc_id").cast("string"), F.lit("\nDoc-Type: old\ndoc type:  "), "lang", F.lit("\n---\n"), "text")
    rows = read(spark, d, "documents").select("doc_id", made.alias("t")).select("doc_id", text.header(F.col("t")).alias("h"), text.body(F.col("t")).alias("b"))
    return rows.select("doc_id", F.col("h")["title"].alias("title"), F.col("h")["source_url"].alias("source_url"), F.col("h")["doc_type"].alias("doc_type"), F.length("b").cast("long").alias("body_length"))


#: Character references of HTML: a number, or a name, of which the longest beginning that is one counts.
REFERENCE = r"'&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)'"
NAMED = ", ".join(f"({_sql(name)}, {_sql(sign)})" for name, sign in sorted(entities.html5.items()))
#: Numbers that stand for something else than their code point.
NUMBERED = ", ".join(f"({n}, {_sql(html.unescape(f'&#{n};'))})" for n in (0, 13, *range(128, 160)))
NO_SIGN = "n BETWEEN 1 AND 8 OR n = 11 OR n BETWEEN 14 AND 31 OR n BETWEEN 127 AND 159 OR n BETWEEN 64976 AND 65007 OR n & 65534 = 65534"


@query(
    rf"""WITH names(name, sign) AS (VALUES {NAMED}), numbered(n, sign) AS (VALUES {NUMBERED}),
a AS (SELECT page_id, row_number() OVER () AS k, regexp_replace(COALESCE(html, ''), '(?is)<style\b.*?</style>|<script\b.*?</script>|<head\b.*?</head>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, k, regexp_replace(regexp_replace(t, '(?i)<br\s*/?>|</(p|div|tr|li|h[1-6]|blockquote)>', E'\n', 'g'), '<[^>]+>', ' ', 'g') AS t FROM a),
r AS MATERIALIZED (SELECT page_id, k, regexp_extract_all(t, {REFERENCE}) AS refs, regexp_split_to_array(t, {REFERENCE}) AS rest FROM b),
u AS (SELECT DISTINCT unnest(refs) AS ref FROM r),
d AS (SELECT ref, ref[3] IN ('x', 'X') AS hex, ltrim(rtrim(substr(ref, CASE WHEN ref[3] IN ('x', 'X') THEN 4 ELSE 3 END), ';'), '0') AS digits FROM u WHERE ref[2] = '#'),
n AS (SELECT ref, CASE WHEN digits = '' THEN 0 WHEN length(digits) > 7 THEN 1114112 WHEN hex THEN ('0x' || digits)::BIGINT ELSE digits::BIGINT END AS n FROM d),
x AS (SELECT ref, substr(ref, 2) AS s, unnest(range(2, length(ref))) AS long FROM u WHERE ref[2] <> '#'),
m AS (SELECT ref, COALESCE(sign, CASE WHEN n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) WHEN {NO_SIGN} THEN '' ELSE chr(n::INTEGER) END) AS sign FROM n LEFT JOIN numbered USING (n)
  UNION ALL SELECT ref, arg_max(sign || substr(s, long + 1), long) FROM x JOIN names ON name = left(s, long) GROUP BY ref),
g AS (SELECT k, list(COALESCE(sign, ref) ORDER BY i) AS signs FROM (SELECT k, unnest(refs) AS ref, unnest(range(len(refs))) AS i FROM r) LEFT JOIN m USING (ref) GROUP BY k),
c AS (SELECT page_id, array_to_string(list_transform(range(1, len(rest) + 1), lambda i: rest[i] || COALESCE(signs[i], '')), '') AS t FROM r LEFT JOIN g USING (k)),
e AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t\x{{a0}}]+', ' ', 'g'), ' *\n *', E'\n', 'g'), '\n{{3,}}', E'\n\n', 'g') AS t FROM c)
SELECT page_id, trim(t, E' \t\n\r\x0B\f') AS text FROM e"""
)
def page_texts(spark, d):
    return read(spark, d, "pages").select("page_id", text.html_text(F.col("html")).alias("text"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '[?]utm_source=[^&]*$', ''), '&ref=[^&]*$', '') AS canonical, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages")
def canonical_urls(spark, d):
    url = F.col("url")
    return read(spark, d, "pages").select("page_id", text.canonical_url(url).alias("canonical"), text.host(url).alias("host"))


@query(
    """WITH q AS (SELECT d.doc_id, d.text, substr(d.text, 11, 60) AS exact, doc_id % 3 AS k FROM documents d), p AS (SELECT doc_id, k, trim(regexp_replace(exact, '\\s+', ' ', 'g')) AS e FROM q)
SELECT doc_id, CASE WHEN e = '' THEN NULL WHEN k = 0 THEN 'verbatim_exact' WHEN k = 1 AND regexp_matches(e, '[\\p{L}\\p{N}]') AND NOT ends_with(e, 'ß') THEN 'verbatim_tokens' WHEN k = 1 THEN 'verbatim_exact' END AS found FROM p WHERE k <> 1"""
)
def quote_matches(spark, d):
    plain = F.expr("substring(text, 11, 60)")
    quote = F.when(F.pmod("doc_id", F.lit(3)) == 0, plain).otherwise(F.when(F.trim(F.regexp_replace(plain, r"\s+", " ")) == "", "").otherwise(F.concat(plain, F.lit(" absent words"))))
    rows = read(spark, d, "documents").where(F.pmod("doc_id", F.lit(3)) != 1)
    return rows.select("doc_id", text.match_quote(quote, F.col("text")).alias("found"))


@query(
    """WITH m AS (SELECT conv_id, role, text, len(list_filter(string_split(text, E'\n\n'), lambda p: len(regexp_extract_all(p, '[^ \\t\\n\\x0B\\f\\r]+')) >= 50)) > 0 AS long_part FROM conversations)
SELECT conv_id, COUNT(*) FILTER (role = 'user') AS asked, SUM(length(text)) FILTER (role IN ('user', 'assistant'))::BIGINT AS characters,
  COUNT(*) FILTER (role = 'user') >= 2 AND COALESCE(SUM(length(text)) FILTER (role IN ('user', 'assistant')), 0) >= 200 AND COALESCE(bool_or(role = 'assistant' AND long_part), FALSE) AS worth FROM m GROUP BY conv_id"""
)
def conversation_gate(spark, d):
    return transcripts.gate(read(spark, d, "conversations"))


@query(
    """SELECT conv_id, string_agg('**' || role || ':** ' || trim(text, ' '), E'\n\n' ORDER BY turn) AS markdown FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id"""
)
def conversation_markdown(spark, d):
    return transcripts.markdown(read(spark, d, "conversations"))


@query(
    """SELECT doc_id, substr(regexp_replace(regexp_replace(lower(source || ' -- ' || lang || '!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS slug,
  rtrim(substr(regexp_extract(trim(regexp_replace(text, '\\s+', ' ', 'g')), '^(.*?[.!?](?: |$)|.*)', 1), 1, 220)) AS sentence FROM documents"""
)
def slugs_and_sentences(spark, d):
    own = F.concat("source", F.lit(" -- "), "lang", F.lit("!"))
    return read(spark, d, "documents").select("doc_id", text.slug(own).alias("slug"), F.rtrim(text.first_sentence(F.col("text"))).alias("sentence"))


@query(
    """SELECT event_id, epoch_us(ts) + 11644473600000000 AS browser_micros, strftime(ts, '%G-W%V') AS week, LEAST(3600.0::DOUBLE, 30 * pow(2.0, user_id % 10)) AS wait FROM events"""
)
def calendar_keys(spark, d):
    at = F.col("ts").cast("timestamp")
    return read(spark, d, "events").select("event_id", dates.to_browser(at).alias("browser_micros"), dates.iso_week(F.col("ts")).alias("week"), dates.back_off(F.pmod("user_id", F.lit(10)) + 1, 30.0, 3600.0).alias("wait"))


@query("SELECT (ts::DATE) AS day, event_type, COUNT(*) AS n, round(SUM(value), 4) AS total FROM events GROUP BY 1, 2")
def daily_events(spark, d):
    return read(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_id, user_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def event_properties(spark, d):
    kind = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return read(spark, d, "events").select("event_id", "user_id", kind.alias("k"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'skip' WHEN page_id % 4 = 1 THEN 'search' WHEN page_id % 4 = 2 THEN 'internal' ELSE 'public' END AS kind FROM pages")
def visit_classes(spark, d):
    k, i = F.pmod("page_id", F.lit(4)), F.col("page_id").cast("string")
    url = F.when(k == 0, F.concat(F.lit("https://x.example.com/login?n="), i)).when(k == 1, F.concat(F.lit("https://www.bing.com/search?q="), i)).when(k == 2, F.concat(F.lit("http://wiki.corp/"), i)).otherwise(F.concat(F.lit("https://x.example.com/"), i))
    return read(spark, d, "pages").select("page_id", text.visit_class(url).alias("kind"))


@query()
def section_chunks(spark, d):
    """id, chunk_index, content: lossless pieces of at most 4000 characters; tests hold them against the texts."""
    return read(spark, d, "documents").select("doc_id", F.posexplode(text.chunks(4000)("text")).alias("chunk_index", "content"))


@query()
def question_index(spark, d):
    """The questions that texts with such a section answer, and those of benchmark passages put under one."""
    made = F.concat(F.lit("Intro\nQuestions this answers: first\n- "), "text", F.lit("\n* last\n\nrest"))
    own = read(spark, d, "benchmark").select(F.col("item_id").alias("id"), text.golden_queries(made).alias("qs"))
    return own.select("id", F.posexplode("qs").alias("place", "query"))


@query(
    with_views(CHUNKS)
    + """, h AS (SELECT parent_id, chunk_index, sha256(content) AS hash, LAG(sha256(content)) OVER (PARTITION BY parent_id ORDER BY chunk_index) AS before FROM chunks)
SELECT parent_id, COUNT(*) AS pieces, COUNT(*) FILTER (hash = before) AS repeated FROM h GROUP BY parent_id"""
)
def repeated_chunks(spark, d):
    by = Window.partitionBy("parent_id").orderBy("chunk_index")
    h = v.chunks(spark, d).withColumn("hash", F.sha2(F.col("content").cast("binary"), 256)).withColumn("before", F.lag("hash").over(by))
    return h.groupBy("parent_id").agg(F.count("*").alias("pieces"), F.count_if(F.col("hash") == F.col("before")).alias("repeated"))

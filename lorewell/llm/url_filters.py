"""URL filters: rules written by hand, and beyond them association rules that FP-growth mines from judged URLs. Native."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

ALLOW, BLOCK = "allow", "block"
#: Host, path and verdict of the rules that hold before any that is mined.
RULES = (("org", "/", ALLOW), ("example.org", "/es/", BLOCK), ("example.org", "/en/1", BLOCK), ("com", "/fr/", ALLOW), ("com", "/de/", BLOCK))
#: Share of the judged URLs that must hold a rule's tokens and verdict, and how often the verdict must follow the tokens.
SUPPORT, CONFIDENCE = 0.01, 0.8
#: Equal rows that one task writes out for mining.
LOT = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def parts_of(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty if the URL is null or has no `://`."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    return lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null; a rule fits its host and all subdomains."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for own, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """What a URL is made of, sorted, each once: scheme, host labels and their ends from the right, words of the path, names of
    the query's fields, a fragment. Letters are lower case and a run of digits is one sign, so numbers don't part URLs."""
    url = F.regexp_replace(lower(F.coalesce(url.cast("string"), F.lit(""))), "[0-9]+", "0")
    host, path = parts_of(url)
    named = lambda parts, kind: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    query = F.regexp_extract(url, r"^[^#?]*\?([^#]*)", 1)
    every = [
        named(F.array(F.regexp_extract(url, r"^([^:/?#]*)://", 1)), "scheme "),
        named(F.split(host, r"[.]"), "host "),
        named(F.array(F.regexp_extract(host, r"([^.]+[.][^.]+)$", 1)), "site "),
        named(F.split(path, r"[^\p{L}\p{N}_-]+"), "path "),
        named(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1)), "field "),
        F.when(url.contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    ]
    return F.array_sort(F.array_distinct(F.concat(*every)))


def mined_rules(judged: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """tokens, verdict, confidence, n (URLs with the tokens and the verdict), key: rules mined from judged (tokens, verdict).

    FP-growth finds the token combinations, verdict included, that at least `support` of the rows hold, among all tokens
    of a row. A rule stays if its verdict follows with `confidence` or more, and if none with one token less is as
    sure: such a rule fits wherever this one does. So two kinds of tokens stand in rules of their own only and are not
    mined: those with one verdict everywhere, and those in all rows. Tokens that stand in the same rows (told by 128
    bits) are mined as one, and each of them makes a rule. `key` is the rarest of a rule's tokens. No rows give no rules.
    """
    n = judged.count()
    if not n:
        return judged.sparkSession.createDataFrame([], "tokens array<string>, verdict string, confidence double, n long, key string")
    # equal rows are brought together before their tokens meet the counts
    sets = cut(judged.groupBy("tokens", "verdict").agg(F.count("*").alias("rows")), "token-sets")
    marks = [F.xxhash64(F.lit(k), "tokens", "verdict").alias(f"mark{k}") for k in (0, 1)]
    held = sets.select(F.explode("tokens").alias("token"), "verdict", "rows", *marks)
    counts = cut(held.groupBy("token", "verdict").agg(F.sum("rows").alias("n"), *[F.bit_xor(f"mark{k}").alias(f"mark{k}") for k in (0, 1)]), "token-counts")
    known = counts.groupBy("token").agg(F.sum("n").alias("times"), F.max("n").alias("most"), *[F.bit_xor(f"mark{k}").alias(f"mark{k}") for k in (0, 1)])
    known = cut(known.where(F.col("times") >= F.lit(n * support)).withColumn("alone", (F.col("most") == F.col("times")) | (F.col("times") == n)), "tokens")
    alike = known.where("NOT alone").groupBy("times", "mark0", "mark1").agg(F.min("token").alias("item"), F.collect_list("token").alias("members"))
    alike = cut(alike.select("item", "members"), "alike")
    ranked = sets.withColumn("token", F.explode_outer("tokens")).join(alike.select(F.col("item").alias("token"), "item"), "token", "left").groupBy("tokens", "verdict")
    items = ranked.agg(F.max("rows").alias("rows"), F.concat(F.collect_list("item"), F.array(F.concat(F.lit("verdict "), "verdict"))).alias("items")).select("items", "rows")
    # a set of very many rows is written out again by more than one task
    lots = items.withColumn("lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / LOT)))).repartition("items", "lot")
    rows = lots.select("items", F.explode(F.sequence(F.lit(1), F.least(F.lit(LOT), F.col("rows") - F.col("lot") * LOT)))).select("items")
    model = FPGrowth(minSupport=support, minConfidence=confidence).fit(cut(rows, "judged"))
    found = model.associationRules.where(F.col("consequent")[0].startswith("verdict ")).where(~F.exists("antecedent", lambda x: x.startswith("verdict ")))
    found = found.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 9, 100).alias("verdict"), "confidence", F.round(F.col("support") * n).cast("long").alias("n"))
    found = cut(found, "rules")
    shorter = found.select("tokens", "verdict", "confidence", F.explode(F.transform("tokens", lambda x: F.array_remove(F.col("tokens"), x))).alias("fewer"))
    as_sure = found.select(F.col("tokens").alias("fewer"), "verdict", F.col("confidence").alias("its"))
    idle = shorter.join(as_sure, ["fewer", "verdict"]).where("its >= confidence").select("tokens", "verdict").distinct()
    kept = found.join(idle, ["tokens", "verdict"], "left_anti")
    # a rule of items is one of each choice of their members
    own = ["tokens", "verdict", "confidence", "n"]
    chosen = kept.select(*own, F.explode("tokens").alias("item")).join(alike, "item").groupBy(*own).agg(F.collect_list("members").alias("members"))
    choices = F.aggregate("members", F.array(F.array().cast("array<string>")), lambda out, m: F.flatten(F.transform(out, lambda x: F.transform(m, lambda y: F.array_append(x, y)))))
    chosen = chosen.select(F.explode(choices).alias("tokens"), "verdict", "confidence", "n").withColumn("tokens", F.array_sort("tokens"))
    single = counts.join(known.where("alone").select("token", "times"), "token").where((F.col("n") >= F.lit(n * support)) & (F.col("n") / F.col("times") >= confidence))
    single = single.select(F.array("token").alias("tokens"), "verdict", (F.col("n") / F.col("times")).alias("confidence"), "n")
    spread = chosen.unionByName(single).select("*", F.explode("tokens").alias("token")).join(known.select("token", "times"), "token")
    key = F.min(F.struct("times", "token"))["token"]
    return cut(spread.groupBy(*own).agg(key.alias("key")), "pruned")


def judged_by_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """tokens and best (confidence, n, verdict, the rule's tokens) for each set of tokens that a rule fits.

    Rules are found under their rarest token and then held against the whole set. The surest wins, then the one with
    more URLs behind it, then `block`, then fewer tokens, then the smaller text.
    """
    index = rules.select(F.col("key").alias("token"), F.col("tokens").alias("needed"), "verdict", "confidence", "n")
    met = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("needed", "tokens")) == 0)
    rank = F.struct((-F.col("confidence")).alias("unsure"), (-F.col("n")).alias("few"), (F.col("verdict") != BLOCK).alias("mild"), F.size("needed").alias("long"), F.array_join("needed", ", ").alias("reason"), "verdict", "confidence")
    return met.groupBy("tokens").agg(F.min(rank).alias("best"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, judged: DataFrame | None = None, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, reason, confidence of every row.

    The longest of `rules` (host, path, verdict) that fits decides; `rule` is it, else null. Where none fits, the
    surest mined rule does: `reason` is its tokens, and `confidence` how sure it is. Where no mined rule fits either
    the URL is allowed. Rules are mined from `judged` (url, verdict); without it, from the pages that `rules` decide.

    A null URL, or one without `://`, has an empty host and path. Each row is judged for itself, so repeated rows,
    null and repeated ids stay rows of their own; an empty table gives no rows. Further columns are ignored.

    URLs fall together into sets of tokens, so a host with a third of all pages is few rows when sets meet rules.
    """
    host, path = parts_of(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("by", ruled(F.col("host"), F.col("path"), rules))
    rows = cut(rows.select("page_id", "host", "path", "by", tokens(F.col("url")).alias("tokens")), "urls")
    learned = rows.where("by IS NOT NULL").select("tokens", F.col("by.verdict").alias("verdict")) if judged is None else judged.where("verdict IS NOT NULL").select(tokens(F.col("url")).alias("tokens"), "verdict")
    mined = mined_rules(learned, support, confidence)
    best = cut(judged_by_rules(rows.where("by IS NULL").select("tokens").distinct(), mined), "judged-sets")
    out = rows.join(best.withColumnRenamed("tokens", "open"), F.col("by").isNull() & (F.col("tokens") == F.col("open")), "left")
    verdict = F.coalesce("by.verdict", "best.verdict", F.lit(ALLOW))
    return out.select("page_id", "host", "path", F.col("by.rule").alias("rule"), verdict.alias("verdict"), F.col("best.reason").alias("reason"), F.col("best.confidence").alias("confidence"))


ORACLE = r"""
WITH parts AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path,
    regexp_replace(translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g') AS plain
  FROM pages),
rules(own, start, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
by_rule AS (
  SELECT p.*, row_number() OVER () AS nr, (SELECT max_by({'rule': own || start, 'verdict': verdict}, length(own || start)) FROM rules WHERE (host = own OR ends_with(host, '.' || own)) AND starts_with(path, start)) AS hit FROM parts p),
tokened AS (
  SELECT *, list_sort(list_distinct(list_concat(
    list_transform(list_filter([regexp_extract(plain, '^([^:/?#]*)://', 1)], lambda x: x <> ''), lambda x: 'scheme ' || x),
    list_transform(list_filter(string_split(regexp_extract(plain, '://([^/?#]*)', 1), '.'), lambda x: x <> ''), lambda x: 'host ' || x),
    list_transform(list_filter([regexp_extract(regexp_extract(plain, '://([^/?#]*)', 1), '([^.]+[.][^.]+)$', 1)], lambda x: x <> ''), lambda x: 'site ' || x),
    list_transform(list_filter(string_split_regex(regexp_extract(plain, '://[^/?#]*([^?#]*)', 1), '[^\p{L}\p{N}_-]+'), lambda x: x <> ''), lambda x: 'path ' || x),
    list_transform(list_filter(list_transform(string_split(regexp_extract(plain, '^[^#?]*\?([^#]*)', 1), '&'), lambda x: regexp_extract(x, '^([^=]*)', 1)), lambda x: x <> ''), lambda x: 'field ' || x),
    CASE WHEN contains(plain, '#') THEN ['fragment'] ELSE [] END))) AS tokens
  FROM by_rule),
judged AS (SELECT nr, tokens, hit.verdict AS verdict FROM tokened WHERE hit IS NOT NULL),
size AS (SELECT count(*) AS n FROM judged),
known AS (SELECT token, count(*) AS times FROM (SELECT unnest(tokens) AS token FROM judged), size GROUP BY token, n HAVING count(*) >= n * 0.01::DOUBLE),
items AS (
  SELECT j.nr, j.verdict, list_sort(list_slice(list(k.token ORDER BY k.times DESC, k.token DESC), 1, 10)) AS items
  FROM (SELECT nr, verdict, unnest(tokens) AS token FROM judged) j JOIN known k USING (token) GROUP BY j.nr, j.verdict),
subsets AS (
  SELECT nr, verdict, list_transform(list_filter(range(1, len(items) + 1), lambda i: (mask >> (i - 1)) % 2 = 1), lambda i: items[i]) AS tokens
  FROM (SELECT nr, verdict, items, unnest(range(1, (2 ** len(items))::BIGINT)) AS mask FROM items)),
counted AS (SELECT tokens, verdict, count(*) AS n, sum(count(*)) OVER (PARTITION BY tokens) AS times FROM subsets GROUP BY tokens, verdict),
found AS (SELECT tokens, verdict, c.n, c.n::DOUBLE / times::DOUBLE AS confidence FROM counted c, size s WHERE c.n >= ceil(0.01::DOUBLE * s.n) AND c.n::DOUBLE / times::DOUBLE >= 0.8),
open_sets AS (SELECT DISTINCT tokens FROM tokened WHERE hit IS NULL),
best AS (
  SELECT o.tokens AS open, arg_min({'verdict': f.verdict, 'confidence': f.confidence, 'reason': array_to_string(f.tokens, ', ')}, (-f.confidence, -f.n, f.verdict <> 'block', len(f.tokens), array_to_string(f.tokens, ', '))) AS best
  FROM open_sets o JOIN found f ON list_has_all(o.tokens, f.tokens) GROUP BY o.tokens)
SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.verdict, best.verdict, 'allow') AS verdict, best.reason AS reason, best.confidence AS confidence
FROM tokened LEFT JOIN best ON hit IS NULL AND tokens = open
"""

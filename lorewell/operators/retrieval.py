"""Hybrid retrieval: lexical and vector legs, rank fusion, caps, and reranking by weighted signals.

Queries are rows (query_id, text), so one plan answers a whole set of them.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stem import lexemes
from ..sources.shared import cut
from .corpus import not_history, parents_without_chunks, where

if TYPE_CHECKING:
    from .term_index import TermIndex

#: What parts words: everything but letters, marks, digits and the underscore.
NOT_WORD = r"[^\p{L}\p{M}\p{N}_]+"
COMMON, K, PREFETCH = 0.05, 60, 40
#: Weights of a term in the title and in the text.
TITLE, BODY = 1.0, 0.4

#: Fixed weights of the reranking signals, and the fixed additions.
WEIGHTS = {"rrf": 0.30, "overlap": 0.18, "title_overlap": 0.18, "context_overlap": 0.10, "recency": 0.12, "length": 0.08, "depth": 0.05}
REINFORCEMENT, TYPE, BOOSTED = 0.03, 0.06, ("idea", "synthesis", "insight", "decision")
CLASS_BOOST = {"semantic": 0.04, "procedural": 0.02}
OTHER_PROJECT, SUPERSEDED, STALE = -0.15, -0.20, -0.05
#: The section of a text whose items weigh like its title.
ASKED = r"(?im)^questions this answers:(.*)\n?((?:[-*] .*\n?)*)"
#: Rows of each leg to begin with, and at most, for so many results.
WIDEN, CEILING = 4, 64


def tokens(text: Column) -> Column:
    """Lower-case words; punctuation parts words."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def terms_in(text: Column, stem: bool) -> Column:
    return lexemes(tokens(text)) if stem else tokens(text)


def query_terms(queries: DataFrame, stem: bool = False) -> DataFrame:
    """query_id, term, terms (their number): the distinct words of each query."""
    return queries.select("query_id", F.array_distinct(terms_in(F.col("text"), stem)).alias("ts")).select("query_id", F.size("ts").alias("terms"), F.explode("ts").alias("term"))


def asked_in(content: Column) -> tuple[Column, Column, Column]:
    """(what is on the line of the heading of questions that a text answers, the text without the items below it, these): the
    line stays in the text."""
    match = F.regexp_extract(content, ASKED, 0)
    items = F.regexp_extract(content, ASKED, 2)
    start = F.position(match, content) + F.length(match) - F.length(items)
    rest = F.concat(F.substr(content, F.lit(1), start - 1), F.substr(content, start + F.length(items)))
    some = F.length(match) > 0
    return F.regexp_extract(content, ASKED, 1), F.when(some, rest).otherwise(content), items


def term_counts(rows: DataFrame, terms: DataFrame, stem: bool = False) -> DataFrame:
    """id, term, weight for the terms asked for, over whole texts: TITLE for each place in the title or among the
    questions that the text answers, BODY for each in the rest.

    Texts meet the terms before they are counted, and counts are partly summed before they are shuffled.
    """
    line, rest, items = asked_in(F.coalesce("content", F.lit("")))
    each = lambda text, w: rows.select("id", F.explode(terms_in(text, stem)).alias("term"), F.lit(w).alias("w"))
    wanted = terms.select("term").distinct()
    both = each(F.concat_ws(" ", "title", line, items), TITLE).unionByName(each(rest, BODY))
    return both.join(wanted, "term", "left_semi").groupBy("id", "term").agg(F.sum("w").alias("weight"))


def eligible(rows: DataFrame, **filters) -> DataFrame:
    """Rows that a search may return: those that equal the filters (type, status, project, source_type, since), without
    superseded chunks unless a status is asked for."""
    found = where(rows, **filters)
    return found if filters.get("status") is not None else found.where(not_history(F.col("parent_id"), F.col("status")))


def lexical_rows(rows: DataFrame, **filters) -> DataFrame:
    """Of the rows that a search may return those that stand for themselves in the lexical leg: no active chunk does, of
    all rows, filtered or not."""
    return parents_without_chunks(eligible(rows, **filters), rows.where("parent_id IS NOT NULL").select("parent_id", "status"))


def common_terms(counts: DataFrame, total: Column | int, threshold: float = COMMON) -> DataFrame:
    """term, frequency: the share of rows that hold a term, for terms above the threshold."""
    share = F.count("*") / (total if isinstance(total, Column) else F.lit(total))
    return counts.groupBy("term").agg(share.alias("frequency")).where(F.col("frequency") > threshold)


def lexical_leg(queries: DataFrame, rows: DataFrame, total: int, prefetch: int = PREFETCH, stem: bool = False) -> DataFrame:
    """query_id, id, pass, score, rank: rows with all terms of a query first, then rows with any that is not common.

    A pass's score is the summed weight of its terms over 1 + ln(characters), x, as x / (1 + x). A query of one term
    has one pass. With `stem`, words are stemmed and stop words left out.
    """
    terms = query_terms(queries, stem)
    size = rows.select("id", (1 + F.log(F.greatest(F.length("content"), F.lit(1)))).alias("size"))
    return rank_of(terms, term_counts(rows, terms, stem), size, total, prefetch)


def rank_of(terms: DataFrame, counts: DataFrame, size: DataFrame, total: int, prefetch: int) -> DataFrame:
    """query_id, id, pass, score, rank from the queries' terms (query_id, term, terms), the rows' (id, term, weight) and what
    a row's weights are divided by (id, size).

    Terms that lead are those that aren't common, or of a query that has only such the least frequent one: any row that
    either pass finds holds one. Common terms, which very many rows hold, are met by rows that hold all that lead only.
    """
    common = common_terms(counts, total)
    rarest = Window.partitionBy("query_id").orderBy(F.col("frequency").asc_nulls_first(), "term")
    rare = F.col("frequency").isNull() | (F.col("terms") == 1)
    asked = terms.join(common, "term", "left").withColumns({"rare": rare, "lead": rare | (F.row_number().over(rarest) == 1)}).drop("frequency")
    leads = asked.groupBy("query_id").agg(F.count_if("lead").alias("leads"))
    first = asked.where("lead").join(counts, "term").groupBy("query_id", "id")
    first = first.agg(F.first("terms").alias("terms"), F.count("*").alias("met"), F.bool_or("rare").alias("rare"), F.sum("weight").alias("weight")).join(leads, "query_id")
    whole = first.where("met = leads AND terms > leads").select("query_id", "id").join(asked.where("NOT lead").select("query_id", "term"), "query_id")
    more = whole.join(counts, ["id", "term"]).groupBy("query_id", "id").agg(F.count("*").alias("more"), F.sum("weight").alias("more_weight"))
    hits = first.join(more, ["query_id", "id"], "left").fillna(0, ["more", "more_weight"])
    every = F.col("met") + F.col("more") == F.col("terms")
    raw = F.when(every, F.col("weight") + F.col("more_weight")).otherwise(F.col("weight")) / F.col("size")
    scored = hits.where(every | F.col("rare")).join(size, "id").select("query_id", "id", F.when(every, 1).otherwise(2).alias("pass"), F.round(raw / (1 + raw), 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy("pass", F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= prefetch)


def fuse(lexical: DataFrame, vector: DataFrame, absent: int, k: int = K) -> DataFrame:
    """query_id, id, rrf, normalised: reciprocal ranks of both legs, the absent rank where a leg lacks a row.

    normalised runs from 0 to 1 over a query's pool; a pool of equal scores is 1 throughout.
    """
    legs = lexical.select("query_id", "id", F.col("rank").alias("rf")).join(vector.select("query_id", "id", F.col("rank").alias("rv")), ["query_id", "id"], "full")
    one = lambda r: 1.0 / (k + F.coalesce(r, F.lit(absent)))
    pool = Window.partitionBy("query_id")
    low, high = F.min("rrf").over(pool), F.max("rrf").over(pool)
    return legs.select("query_id", "id", (one("rv") + one("rf")).alias("rrf")).withColumn("normalised", F.when(high > low, (F.col("rrf") - low) / (high - low)).otherwise(1.0))


def cap_per_parent(pool: DataFrame, limit: int, cap: int) -> DataFrame:
    """The best rows of each query, at most `cap` of a parent, and no second row with the same content and project.

    pool: (query_id, id, parent_id, project, content, score). Greedy from the best on: a row falls out if its content
    (white space collapsed, case folded; empty content is exempt) or its parent's cap is used up by rows already
    kept. Adds `kept_rank` and `other_chunks`, the pool's rows of the parent that weren't kept. A pool is what the
    legs fetched, so its size is bounded by them.
    """

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "id"], ascending=[False, True])
        parents = group["parent_id"].fillna(group["id"]).astype("int64")
        seen, used, kept = set(), {}, []
        for at, content, project, parent in zip(group.index, group["content"], group["project"], parents, strict=True):
            twin = (" ".join((content or "").split()).casefold(), project)
            if len(kept) < limit and not (twin[0] and twin in seen) and used.get(parent, 0) < cap:
                seen.add(twin)
                used[parent] = used.get(parent, 0) + 1
                kept.append(at)
        out = group.loc[kept, ["query_id", "id", "score"]]
        of = parents.loc[kept]
        return out.assign(kept_rank=range(1, len(out) + 1), other_chunks=[int((parents == p).sum()) - used[p] for p in of])

    slim = pool.select("query_id", "id", "parent_id", "project", "content", "score")
    return slim.groupBy("query_id").applyInPandas(keep, "query_id long, id long, score double, kept_rank long, other_chunks long")


def overlap(query: Column, words: Column) -> Column:
    """Share of the query's words that the document has, whole or, from four letters on, as a beginning either way."""
    rest = F.array_except(query, words)
    akin = lambda t: F.exists(words, lambda w: (F.length(t) >= 4) & (F.startswith(w, t) | ((F.length(w) >= 4) & F.startswith(t, w))))
    met = F.size(query) - F.size(F.filter(rest, lambda t: ~akin(t)))
    return F.when(F.size(query) > 0, met / F.size(query)).otherwise(0.0)


def days(as_of: Column, then: Column) -> Column:
    return F.greatest(F.lit(0.0), F.timestamp_diff("SECOND", then, as_of) / 86400.0)


def overlaps(pool: DataFrame, rows: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id, overlap (with title and content), title_overlap, context_overlap, length of the pool's pairs.

    A row's words are taken once, beside the queries that found it; a pair carries numbers, not texts.
    """
    asked = pool.select("query_id", "id").join(queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("words")), "query_id")
    asked = asked.groupBy("id").agg(F.collect_list(F.struct("query_id", "words")).alias("_asked"))
    own = rows.select("id", *[F.array_distinct(tokens(F.col(c))).alias(f"_{c}") for c in ("title", "content", "encoding_context")]).join(asked, "id")
    own = own.withColumn("_all", F.array_union("_title", "_content")).withColumn("_length", F.least(F.lit(1.0), F.size("_content") / 80.0))

    def told(q: Column) -> Column:
        of = {"overlap": "_all", "title_overlap": "_title", "context_overlap": "_encoding_context"}
        return F.struct(q["query_id"].alias("query_id"), *[overlap(q["words"], F.col(c)).alias(n) for n, c in of.items()])

    return own.select("id", F.col("_length").alias("length"), F.explode(F.transform("_asked", told)).alias("_of")).select("_of.*", "id", "length")


def signals(pool: DataFrame, rows: DataFrame, queries: DataFrame, as_of: str, index: TermIndex | None = None) -> DataFrame:
    """The pool (query_id, id, normalised, ...) with the thirteen reranking signals of its rows.

    rows: (id, type, title, content, project, status, mem_class, access_count, depth, encoding_context, created_at,
    last_accessed_at); queries: (query_id, text, query_project). A row that was never accessed has the whole spacing
    bonus; one without a date the recency of an old one and no staleness. With an index no text is read: the overlaps are
    those of its entries, and the rows' other columns are taken from it.
    """
    if index is not None:
        rows, told = index.docs, index.overlaps(pool, queries)
    else:
        told = overlaps(pool, rows, queries)
    now, used = F.lit(as_of).cast("timestamp_ntz"), F.coalesce("access_count", F.lit(0))
    age, since = days(now, F.col("created_at")), days(now, F.col("last_accessed_at"))
    light = rows.select("id", "type", "project", "status", "mem_class", "access_count", "depth", "created_at", "last_accessed_at")
    wide = pool.join(told, ["query_id", "id"]).join(light, "id").join(queries.select("query_id", "query_project"), "query_id")
    spacing = F.when(F.col("last_accessed_at").isNull(), 1.0).otherwise(F.least(F.lit(1.0), since / 7))
    classes = F.create_map(*[F.lit(x) for kv in CLASS_BOOST.items() for x in kv])
    other = F.col("query_project").isNotNull() & (F.col("query_project") != "") & F.col("project").isNotNull() & (F.col("project") != "") & (F.col("project") != F.col("query_project"))
    return wide.withColumns(
        {
            "recency": F.when(F.col("created_at").isNull(), 0.35).otherwise(F.pow(1 + age / (30 + 10 * F.log1p(used)), -0.8)),
            "depth": F.coalesce("depth", F.lit(0.0)),
            "spacing": spacing,
            "reinforcement": REINFORCEMENT * F.log1p(used) * spacing,
            "type_boost": F.when(F.col("type").isin(*BOOSTED), TYPE).otherwise(0.0),
            "class_boost": F.coalesce(classes[F.col("mem_class")], F.lit(0.0)),
            "project_penalty": F.when(other, OTHER_PROJECT).otherwise(0.0),
            "superseded_penalty": F.when(F.col("status") == "superseded", SUPERSEDED).otherwise(0.0),
            "staleness_penalty": F.when((used == 0) & (age > 90), STALE * F.least(F.lit(1.0), (age - 90) / 180)).otherwise(0.0),
        }
    )


ADDED = ("reinforcement", "type_boost", "class_boost", "project_penalty", "superseded_penalty", "staleness_penalty")


def score(weights: dict[str, Column | float] | None = None, multipliers: dict[str, Column | float] | None = None, spacing: Column | float | None = None) -> Column:
    """The weighted sum of the signals, and the additions.

    Stored signals can be scored again: weights replace those of signals, multipliers scale additions (a factor of 0
    leaves one out), and `spacing` replaces the spacing bonus. All may be columns, so that one plan scores under many sets.
    """
    w, m = WEIGHTS | (weights or {}), multipliers or {}
    named = {"rrf": "normalised"}
    total = sum((F.col(named.get(k, k)) * w[k] for k in WEIGHTS), F.lit(0.0))
    added = {k: F.col(k) for k in ADDED}
    if spacing is not None:
        added["reinforcement"] = REINFORCEMENT * F.log1p(F.coalesce("access_count", F.lit(0))) * spacing
    return total + sum((x * m.get(k, 1.0) for k, x in added.items()), F.lit(0.0))


def rerank(pool: DataFrame, rows: DataFrame, queries: DataFrame, as_of: str, weights: dict[str, Column | float] | None = None, index: TermIndex | None = None) -> DataFrame:
    """The pool with signals, rerank_score and final_rank, ties to the smaller id."""
    best = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "id")
    return signals(pool, rows, queries, as_of, index).withColumn("rerank_score", F.round(score(weights), 6)).withColumn("final_rank", F.row_number().over(best))


def legs(queries: DataFrame, rows: DataFrame, vectors: DataFrame | None, prefetch: int, index: TermIndex | None = None, **filters) -> tuple[DataFrame, DataFrame]:
    """(lexical, vector): both legs over the rows that the filters leave; rows without a vector are found by words only."""
    from .vectors import top_k

    if index is not None:
        rows, lexical = index.docs, index.lexical_leg(queries.select("query_id", "text"), prefetch, **filters)
    else:
        lexical = lexical_leg(queries.select("query_id", "text"), lexical_rows(rows, **filters), rows.count(), prefetch)
    if vectors is None:
        return lexical, lexical.limit(0)
    return lexical, top_k(queries.select("query_id", "embedding"), vectors.join(eligible(rows, **filters).select("id"), "id", "left_semi"), prefetch)


def hybrid(queries: DataFrame, rows: DataFrame, vectors: DataFrame | None, limit: int = 10, cap: int = 2, index: TermIndex | None = None, **filters) -> DataFrame:
    """query_id, id, normalised, kept_rank, other_chunks: fused and capped results of each query.

    Each leg fetches WIDEN x limit rows. A query that caps and twins leave with fewer than `limit` results, though a leg
    was full, is asked again with twice as many, as long as there are such queries and at most up to CEILING x
    limit (512 at least, 4,096 at most); the ranks, and so the scores, are those of its last round. What a round finds
    is written to the shared folder, numbers only.
    """
    prefetch, ceiling = max(limit * WIDEN, 4), min(max(limit * CEILING, 512), 4096)
    left, found = queries, None
    of = index.docs.withColumn("content", F.col("twin")) if index is not None else rows
    while True:
        lexical, vector = (cut(x, "leg") for x in legs(left, rows, vectors, prefetch, index, **filters))
        pool = fuse(lexical, vector, prefetch + 1)
        kept = cap_per_parent(pool.join(of.select("id", "parent_id", "project", "content"), "id").withColumn("score", F.col("normalised")), limit, cap)
        kept = cut(kept.withColumnRenamed("score", "normalised"), "kept")
        full = lexical.groupBy("query_id").count().unionByName(vector.groupBy("query_id").count()).where(F.col("count") >= prefetch).select("query_id").distinct()
        short = full.join(kept.groupBy("query_id").count().where(F.col("count") >= limit), "query_id", "left_anti")
        again = cut(left.join(short, "query_id", "left_semi"), "again") if prefetch < ceiling else None
        done = again is None or again.isEmpty()
        own = kept if done else kept.join(again.select("query_id"), "query_id", "left_anti")
        found = own if found is None else found.unionByName(own)
        if done:
            return found
        left, prefetch = again, min(prefetch * 2, ceiling)


def search(queries: DataFrame, rows: DataFrame, vectors: DataFrame | None, as_of: str, limit: int = 10, cap: int = 1, index: TermIndex | None = None, **filters) -> DataFrame:
    """query_id, id, final_rank, rerank_score, other_chunks: both legs, fusion, caps and reranking.

    queries: (query_id, text, embedding, query_project); rows: (id, parent_id, title, content, ...) of any number;
    vectors: (id, embedding). Ids and numbers are ranked first; texts are read again for the rows that were kept. With an
    index of the rows no text is read.
    """
    kept = hybrid(queries, rows, vectors, limit, cap, index, **filters)
    return rerank(kept, rows, queries, as_of, index=index).select("query_id", "id", "final_rank", "rerank_score", "other_chunks")


def around(hits: DataFrame, rows: DataFrame, edges: DataFrame, top: int = 5, near: int = 3) -> DataFrame:
    """query_id, id, kind, other: what a search shows beside its best hits.

    For the best hit the `near` parent rows created within a day of it, nearest first (`temporal`); for the `top` best
    the schemas that hold one of them, at most `near` of a query, by hit and then id (`schema`).
    """
    parents = rows.where("parent_id IS NULL AND status = 'active'").select(F.col("id").alias("other"), F.col("created_at").alias("_at"))
    first = hits.where("final_rank = 1").join(rows.select("id", "created_at"), "id")
    gap = F.abs(F.unix_micros(F.col("created_at").cast("timestamp")) - F.unix_micros(F.col("_at").cast("timestamp")))
    day = F.expr("INTERVAL 1 DAY")
    key = F.date_trunc("DAY", "created_at")
    days_of = first.withColumn("_day", F.explode(F.array(key - day, key, key + day)))
    pairs = days_of.join(parents.withColumn("_day", F.date_trunc("DAY", "_at")), "_day").where(F.col("other") != F.col("id")).withColumn("_gap", gap).where(F.col("_gap") <= 86_400_000_000)
    nearest = Window.partitionBy("query_id").orderBy("_gap", "other")
    temporal = pairs.withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= near).select("query_id", "id", F.lit("temporal").alias("kind"), "other")
    live = edges.where("relation = 'schema_contains' AND expired_at IS NULL").select(F.col("source_id").alias("other"), F.col("target_id").alias("id")).distinct()
    held = hits.where(F.col("final_rank") <= top).join(live, "id").groupBy("query_id", "other").agg(F.min_by("id", "final_rank").alias("id"), F.min("final_rank").alias("_rank"))
    order = Window.partitionBy("query_id").orderBy("_rank", "other")
    schema = held.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= near).select("query_id", "id", F.lit("schema").alias("kind"), "other")
    return temporal.unionByName(schema)


def shown(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """hits with what is presented of them: title, the text's first 500 characters, the score to three places."""
    return hits.join(rows.select("id", "title", F.substring("content", 1, 500).alias("preview")), "id").withColumn("shown_score", F.round("rerank_score", 3))


def learn(topics: DataFrame, rows: DataFrame, vectors: DataFrame | None, as_of: str, each: int = 5, kept: int = 3, index: TermIndex | None = None) -> DataFrame:
    """query_id, topic, id, rank: for each topic of a request the `kept` best of `each` results of a search of its own,
    reranked against the topic alone.

    topics: (query_id, topic, text, embedding), the text being what is searched for.
    """
    keyed = topics.withColumn("_key", F.xxhash64("query_id", "topic"))
    asked = keyed.select(F.col("_key").alias("query_id"), "text", "embedding")
    found = hybrid(asked, rows, vectors, each, 1, index)
    alone = keyed.select(F.col("_key").alias("query_id"), F.col("topic").alias("text"), F.lit(None).cast("string").alias("query_project"))
    best = rerank(found, rows, alone, as_of, index=index).where(F.col("final_rank") <= kept).select(F.col("query_id").alias("_key"), "id", F.col("final_rank").alias("rank"))
    return best.join(keyed.select("_key", "query_id", "topic"), "_key").select("query_id", "topic", "id", "rank")

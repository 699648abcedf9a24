"""Every query against its SQL on the smallest tables, and those without SQL against plain versions."""

import math

import duckdb
import pytest

from lorewell.functions import text
from lorewell.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_like_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted(names) == columns and got == want


def test_all_queries_have_sql_or_a_test():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"strike_ledger", "section_chunks", "question_index", "hybrid_parent_cap", "memory_search", "memory_search_of_project", "search_context", "learned_topics", "recall_at_k", "assembled_turns", "greedy_clusters", "subsequence_turns", "weight_optimum"}


def test_section_chunks(spark, duck):
    pieces = {}
    for r in sorted(catalog.queries()["section_chunks"](spark, SF).collect(), key=lambda r: (r.doc_id, r.chunk_index)):
        assert len(r.content) <= 4000
        pieces[r.doc_id] = pieces.get(r.doc_id, "") + r.content
    assert pieces == {i: t for i, t in duck.execute("SELECT doc_id, text FROM documents WHERE text <> ''").fetchall()}


def test_question_index(spark, duck):
    got = {}
    for r in catalog.queries()["question_index"](spark, SF).collect():
        got.setdefault(r.id, []).append((r.place, r["query"]))
    for i, t in duck.execute("SELECT item_id, text FROM benchmark").fetchall():
        assert [q for _, q in sorted(got[i])] == text.queries_of(f"Intro\nQuestions this answers: first\n- {t}\n* last\n\nrest")


def kept_by(pool, limit, cap):
    """Best first by score, then id: no twin content within a project, at most `cap` of a parent; and what else the pool has of it."""
    kept, seen, used = [], set(), {}
    parent = lambda r: r["parent_id"] if r["parent_id"] is not None else r["id"]
    for r in sorted(pool, key=lambda r: (-r["score"], r["id"])):
        twin = (" ".join((r["content"] or "").split()).casefold(), r["project"])
        if len(kept) < limit and not (twin[0] and twin in seen) and used.get(parent(r), 0) < cap:
            seen.add(twin)
            used[parent(r)] = used.get(parent(r), 0) + 1
            kept.append(r)
    return [(r["id"], sum(parent(x) == parent(r) for x in pool) - used[parent(r)]) for r in kept]


def rows_of(spark):
    from lorewell.plans import retrieval_queries

    return {r.id: r.asDict() for r in retrieval_queries._rows(spark, SF).collect()}


def test_parent_cap(spark):
    from lorewell.plans import retrieval_queries

    got, rows, pools = {}, rows_of(spark), {}
    for r in catalog.queries()["hybrid_parent_cap"](spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.kept_rank, r.id, r.other_chunks))
    for r in retrieval_queries._pool(spark, SF).collect():
        if r.id in rows:
            pools.setdefault(r.query_id, []).append(rows[r.id] | {"score": r.normalised})
    for q, pool in pools.items():
        assert [x[1:] for x in sorted(got[q])] == kept_by(pool, 10, 1)


class Plain:
    """Search by loops: legs, fusion, caps, adaptive pools and reranking."""

    def __init__(self, rows, vectors, queries):
        import re

        self.words = lambda t: [w for w in re.split(r"[^\w]+", (t or "").lower()) if w]
        self.rows, self.vectors, self.queries = rows, vectors, queries
        self.covered = {r["parent_id"] for r in rows.values() if r["parent_id"] is not None and r["status"] == "active"}

    def eligible(self, project, status):
        return {
            i: r
            for i, r in self.rows.items()
            if (project is None or r["project"] in (project, None)) and (r["status"] == status if status else not (r["parent_id"] is not None and r["status"] == "superseded"))
        }

    def counts(self, own):
        import re
        from collections import Counter

        table = {}
        for i, r in own.items():
            c, content = Counter(), r["content"] or ""
            m = re.search(r"(?im)^questions this answers:(.*)\n?((?:[-*] .*\n?)*)", content)
            first = [r["title"] or ""] + ([m[1], m[2]] if m else [])
            rest = content[: m.start(2)] + content[m.end(2) :] if m else content
            for w in self.words(" ".join(first)):
                c[w] += 1.0
            for w in self.words(rest):
                c[w] += 0.4
            table[i] = c
        return table

    def lexical(self, text, counts, own, prefetch, total):
        terms = list(dict.fromkeys(self.words(text)))
        common = {t for t in terms if sum(t in c for c in counts.values()) / total > 0.05}
        rare = [t for t in terms if t not in common or len(terms) == 1]
        scored = []
        for i, c in counts.items():
            every = all(t in c for t in terms) and terms
            hit = terms if every else [t for t in rare if t in c]
            if hit:
                x = sum(c[t] for t in hit) / (1 + math.log(max(1, len(own[i]["content"] or ""))))
                scored.append((1 if every else 2, -round(x / (1 + x), 9), i))
        return {i: n + 1 for n, (_, _, i) in enumerate(sorted(scored)[:prefetch])}

    def search(self, q, text, vector, project, limit=10, cap=1, filters=(None, None)):
        import numpy as np

        own = self.eligible(*filters)
        counts = self.counts({i: r for i, r in own.items() if i not in self.covered})
        near = sorted((-float(np.dot(vector, v)), i) for i, v in self.vectors.items() if i in own) if vector is not None else []
        prefetch, ceiling = limit * 4, max(limit * 64, 512)
        while True:
            lexical = self.lexical(text, counts, own, prefetch, len(self.rows))
            nearest = {i: n + 1 for n, (_, i) in enumerate(near[:prefetch])}
            fused = {i: 1 / (60 + nearest.get(i, prefetch + 1)) + 1 / (60 + lexical.get(i, prefetch + 1)) for i in lexical.keys() | nearest.keys()}
            if not fused:
                return []
            low, high = min(fused.values()), max(fused.values())
            pool = [self.rows[i] | {"score": (x - low) / (high - low) if high > low else 1.0} for i, x in fused.items()]
            kept = kept_by(pool, limit, cap)
            if len(kept) >= limit or max(len(lexical), len(nearest)) < prefetch or prefetch >= ceiling:
                break
            prefetch = min(prefetch * 2, ceiling)
        score = {r["id"]: r["score"] for r in pool}
        ranked = sorted((-round(self.rerank(self.rows[i], score[i], text, project), 6), i) for i, _ in kept)
        return [(i, -s) for s, i in ranked]

    def overlap(self, query, words):
        met = sum(t in words or (len(t) >= 4 and any(w.startswith(t) or (len(w) >= 4 and t.startswith(w)) for w in words)) for t in query)
        return met / len(query) if query else 0.0

    def rerank(self, r, rrf, text, project):
        import datetime as dt

        from lorewell.plans.views import AS_OF

        now, used = dt.datetime.fromisoformat(AS_OF), r["access_count"] or 0
        query, content, title, context = (set(self.words(x)) for x in (text, r["content"], r["title"], r["encoding_context"]))
        days = lambda t: max(0.0, (now - t).total_seconds() / 86400)
        total = 0.30 * rrf + 0.18 * self.overlap(query, content | title) + 0.18 * self.overlap(query, title) + 0.10 * self.overlap(query, context)
        total += 0.12 * ((1 + days(r["created_at"]) / (30 + 10 * math.log1p(used))) ** -0.8 if r["created_at"] else 0.35) + 0.08 * min(1.0, len(content) / 80) + 0.05 * (r["depth"] or 0)
        total += 0.06 * (r["type"] in ("idea", "synthesis", "insight", "decision")) + {"semantic": 0.04, "procedural": 0.02}.get(r["mem_class"], 0)
        total += 0.03 * math.log1p(used) * (min(1.0, days(r["last_accessed_at"]) / 7) if r["last_accessed_at"] else 1.0)
        if project and r["project"] and r["project"] != project:
            total -= 0.15
        if r["status"] == "superseded":
            total -= 0.20
        if r["created_at"] and not used and days(r["created_at"]) > 90:
            total -= 0.05 * min(1.0, (days(r["created_at"]) - 90) / 180)
        return total


@pytest.mark.parametrize(("name", "filters"), [("memory_search", (None, None)), ("memory_search_of_project", ("en", "active"))])
def test_memory_search(spark, duck, name, filters):
    import numpy as np

    vectors = {i: np.array(e, float) / np.linalg.norm(e) for i, e in duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall()}
    queries = duck.execute("SELECT item_id, text FROM benchmark ORDER BY item_id").fetchall()
    search, got = Plain(rows_of(spark), vectors, queries), {}
    for r in catalog.queries()[name](spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.final_rank, r.id, r.rerank_score))
    for q, text_ in queries[::4]:
        want = search.search(q, text_, vectors.get(q), "en", filters=filters)
        own = sorted(got.get(q, []))
        assert [x for _, x, _ in own] == [x for x, _ in want], q
        assert [s for _, _, s in own] == pytest.approx([s for _, s in want], abs=2e-6)


def test_search_context(spark, duck):
    rows, got = rows_of(spark), {}
    hits = {}
    for r in catalog.queries()["memory_search"](spark, SF).collect():
        hits.setdefault(r.query_id, []).append((r.final_rank, r.id))
    for r in catalog.queries()["search_context"](spark, SF).collect():
        got.setdefault((r.query_id, r.kind), set()).add(r.other)
    edges = set(duck.execute(f"WITH {__import__('lorewell.plans.views', fromlist=['EDGES']).EDGES} SELECT source_id, target_id FROM edges WHERE relation = 'schema_contains' AND expired_at IS NULL").fetchall())
    for q, own in hits.items():
        first, top = min(own)[1], [i for n, i in sorted(own) if n <= 5]
        at = rows[first]["created_at"]
        near = [] if at is None else sorted((abs((r["created_at"] - at).total_seconds()), i) for i, r in rows.items() if i != first and r["parent_id"] is None and r["status"] == "active" and r["created_at"] and abs((r["created_at"] - at).total_seconds()) <= 86400)
        assert got.get((q, "temporal"), set()) == {i for _, i in near[:3]}
        held = {}
        for n, i in enumerate(top):
            for s, t in edges:
                if t == i:
                    held[s] = min(held.get(s, 99), n)
        assert got.get((q, "schema"), set()) == {s for _, s in sorted((n, s) for s, n in held.items())[:3]}


def test_learned_topics(spark, duck):
    import numpy as np

    vectors = {i: np.array(e, float) / np.linalg.norm(e) for i, e in duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall()}
    search, got = Plain(rows_of(spark), vectors, []), {}
    for r in catalog.queries()["learned_topics"](spark, SF).collect():
        got.setdefault((r.query_id, r.topic), []).append((r.rank, r.id))
    for q, topic in sorted(got)[::9]:
        want = search.search(q, topic, vectors.get(q), None, limit=5)
        assert [i for _, i in sorted(got[q, topic])] == [i for i, _ in want[:3]], (q, topic)


def test_recall_of_the_approximate_search(spark):
    rows = catalog.queries()["recall_at_k"](spark, SF).collect()
    assert len(rows) == 10 and sum(r.recall for r in rows) / len(rows) >= 0.95
    larger = catalog.queries()["recall_at_k"](spark, "/root/testdata/sf0.1").collect()
    assert len(larger) == 40 and sum(r.recall for r in larger) / len(larger) >= 0.95 and max(r.share_scored for r in larger) < 0.1


def test_greedy_clusters(spark, duck):
    import numpy as np

    got = {r.id: (r.label, r.cluster) for r in catalog.queries()["greedy_clusters"](spark, SF).collect()}
    rows = duck.execute("SELECT label, vec_id, embedding FROM embeddings ORDER BY label, vec_id").fetchall()
    for label in {r[0] for r in rows}:
        own = [(i, np.array(e) / np.linalg.norm(e)) for lab, i, e in rows if lab == label]
        seeds, at = [], {}
        for i, v in own:
            scores = [float(s @ v) for s in seeds]
            if scores and max(scores) >= 0.45:
                at[i] = scores.index(max(scores))
            else:
                at[i] = len(seeds)
                seeds.append(v)
        sizes = [list(at.values()).count(k) for k in range(len(seeds))]
        numbers = {k: n for n, k in enumerate(k for k in range(len(seeds)) if sizes[k] > 1)}
        assert {i: got[i][1] for i, _ in own} == {i: numbers.get(k) for i, k in at.items()}


def test_subsequence_turns(spark):
    from pyspark.sql import functions as F

    from lorewell.operators import curation

    turns, got = {}, {r.conv_id: r.contained for r in catalog.queries()["subsequence_turns"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    for c, own in turns.items():
        part = [t for role, t in own if role == "user"][:: -1 if c % 2 else 1]
        rest = iter([t for _, t in own])
        assert got[c] == all(any(x == t for x in rest) for t in part)
    assert set(got.values()) == {True, False}
    df = spark.createDataFrame([(["a", "b", "a", "c"], ["a", "a", "c"]), (["a", "b"], ["b", "a"]), (["a"], []), ([], ["a"])], "w array<string>, p array<string>")
    assert [r[0] for r in df.select(curation.contains_in_order(F.col("w"), F.col("p"))).collect()] == [True, False, True, False]


def test_strikes(spark):
    from lorewell.operators import monitor

    t = lambda d, h=0: f"2024-01-{d:02d} {h:02d}:00:00"
    rows = [("a", t(1), "failed"), ("a", t(1, 5), "failed"), ("a", t(2), "failed"), ("a", t(3), "deferred"), ("a", t(4), "failed"), ("a", t(5), "failed"), ("b", t(1), "failed"), ("b", t(2), "ok"), ("c", t(1), "deferred"), *(("d", t(n), "deferred") for n in range(1, 8)), *(("e", t(n), o) for n, o in enumerate(("deferred", "deferred", "failed", "deferred", "deferred"), 1)), ("f", t(1), "failed"), ("f", t(2), "too_short"), ("f", t(2, 5), "failed"), ("g", t(1), None)]
    df = spark.createDataFrame(rows, "key string, at string, outcome string").selectExpr("key", "cast(at as timestamp_ntz) at", "outcome")
    got = {r.key: r for r in monitor.strikes(df).collect()}
    assert (got["a"].strikes, str(got["a"].cool_until)) == (4, "2024-02-04 00:00:00") and got["b"].strikes == got["c"].strikes == 0
    assert (got["d"].strikes, got["e"].strikes, got["f"].strikes, got["f"].cool_until) == (2, 1, 1, None) and "g" not in got

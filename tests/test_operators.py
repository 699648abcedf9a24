"""Operators on small hand-made rows, and properties of the text functions."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorewell.functions import dates, text
from lorewell.operators import corpus, evaluation, graph, ledger, retrieval, store, vectors

LETTERS = st.text(alphabet="ab #\n-", max_size=400)


@given(LETTERS, st.integers(1, 40))
@settings(max_examples=200, deadline=None)
def test_chunks_are_lossless(t, most):
    pieces = text.split_sections(t, most)
    assert "".join(pieces) == t and all(0 < len(p) <= most for p in pieces)


def test_chunks_prefer_headings():
    body = "a" * 60 + "\n## Next\n" + "b" * 50
    assert text.split_sections(body, 100)[1].startswith("## Next")
    assert text.split_sections("a" * 250, 100) == ["a" * 100, "a" * 100, "a" * 50]


@given(LETTERS)
def test_questions_without_a_section(t):
    assert text.questions_of("x" + t.replace("questions", "")) == ("", "x" + t.replace("questions", ""))


def test_questions():
    t = "Intro\nQuestions this answers: why\n- how\n* what\n\n- later\nquestions this answers: no"
    assert text.questions_of(t) == ("why how what", "Intro\nQuestions this answers: why\n\n- later\nquestions this answers: no")
    assert text.queries_of("  Questions this answers:\n\n - a \n* b\nc\n- d") == ["a", "b"]


@pytest.mark.parametrize(
    ("reply", "want"),
    [('{"a": 1}', {"a": 1}), ('so:\n```json\n{"a": [1]}\n```', {"a": [1]}), ('x {"a": "}"} y [1, 2, 3, 4, 5, 6, 7] {', [1, 2, 3, 4, 5, 6, 7]), ("\x1b[31m[1]\x1b[0m", [1]), ("none", None), (None, None)],
)
def test_json_in_replies(reply, want):
    got = text.json_in(reply)
    assert (json.loads(got) if got else None) == want


def column(spark, f, values, kind="string"):
    return [r[1] for r in spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}").select("i", f(F.col("v"))).orderBy("i").collect()]


def test_text_columns(spark):
    assert column(spark, text.project_tag, ["/home/me", "/home/me/Proj/", "C:\\a\\B", " .git ", "", None, "0123456789abcdef0123456789abcdef", "x"]) == [None, "proj", "b", None, None, None, None, "x"]
    assert column(spark, text.header, ["# T\nSource-URL: a:b\n a b : 1\nA b: 2\n---\nc: d", "no header"]) == [{"title": "T", "source_url": "a:b", "a_b": "2"}, {}]
    assert column(spark, text.body, ["# T\n---\n\n body \n---\nx", "all"]) == ["body \n---\nx", "all"]
    assert column(spark, text.html_text, ["<head><title>x</title></head><p>A &amp; b</p><p>c<br/>d</p><script>z</script>", None, ""]) == ["A & b\nc\nd", "", ""]
    assert column(spark, text.canonical_url, ["https://h/p?a=1&utm_x=2&token=z&b=#f", "https://h/p?ref=1", "https://h/p#x"]) == ["https://h/p?a=1&b=", "https://h/p", "https://h/p"]
    assert column(spark, text.visit_class, ["ftp://x", "https://mail.x.com/", "https://www.google.com/search?q=a", "https://x.com/Login?a", "https://team.slack.com/x", "https://a.corp/b", "https://x.com", ""]) == ["skip", "app", "search", "skip", "chat", "internal", "public", "skip"]
    assert column(spark, lambda c: text.shortened(c, 5), ["abcdefg", "abc", None]) == ["abcd…", "abc", None]
    source = F.lit("He said:  **ship** it\non the 14th.")
    assert column(spark, lambda c: text.match_quote(c, source), ["ship** it on", "SHIP it", "hip it", "", None]) == ["verbatim_exact", "verbatim_tokens", None, None, None]
    assert column(spark, lambda c: text.classify(F.lit("decision"), c), ["How to do", "plain", "1. a\n2. b\n3. c"]) == ["procedural", "semantic", "procedural"]


def test_dates(spark):
    df = spark.sql("SELECT date'2024-03-10' AS d")
    a, b = (r for r in df.select(*dates.day_bounds(F.col("d"), "America/New_York")).first())
    assert (b - a).total_seconds() == 23 * 3600
    assert spark.sql("SELECT timestamp'2024-12-30 01:00:00' t").select(dates.iso_week(F.col("t"))).first()[0] == "2025-W01"
    assert spark.range(1).select(dates.from_browser(F.lit(13_344_473_600_000_000))).first()[0].year == 2023


def test_lexical_passes(spark):
    rows = spark.createDataFrame([(1, "Red fox", "the quick red fox"), (2, "x", "red"), (3, "y", "fox fox"), (4, "É", "l'été rouge"), (5, "n", None)], "id long, title string, content string")
    queries = spark.createDataFrame([(1, "red FOX!"), (2, "ÉTÉ"), (3, "...")], "query_id long, text string")
    got = [tuple(r) for r in retrieval.lexical_leg(queries, rows, 100).orderBy("query_id", "rank").select("query_id", "id", "pass").collect()]
    assert got == [(1, 1, 1), (1, 3, 2), (1, 2, 2), (2, 4, 1)]


def test_stems(spark):
    words = ["queries", "aeries", "files", "shoes", "words", "gas", "class", "bus", "is", "été"]
    assert column(spark, text.light_stem, words) == ["query", "aery", "file", "shoes", "word", "gas", "class", "bus", "is", "été"]
    rows = spark.createDataFrame([(1, "t", "two queries"), (2, "t", "none")], "id long, title string, content string")
    asked = spark.createDataFrame([(1, "query")], "query_id long, text string")
    assert retrieval.lexical_leg(asked, rows, 2).count() == 0 and [r.id for r in retrieval.lexical_leg(asked, rows, 100, stem=True).collect()] == [1]


def test_overlap(spark):
    df = spark.createDataFrame([(["conn", "a", "connections", "zzz"], ["connect", "b", "conne"])], "q array<string>, d array<string>")
    assert df.select(retrieval.overlap(F.col("q"), F.col("d"))).first()[0] == 0.5


@given(st.dictionaries(st.integers(0, 30), st.integers(1, 40), max_size=8), st.dictionaries(st.integers(0, 30), st.integers(1, 40), max_size=8))
@settings(max_examples=5, deadline=None)
def test_fusion(spark, a, b):
    leg = lambda r: spark.createDataFrame([(1, i, k) for i, k in r.items()], "query_id long, id long, rank long")
    got = {r.id: r for r in retrieval.fuse(leg(a), leg(b), 41).collect()}
    want = {i: 1 / (60 + a.get(i, 41)) + 1 / (60 + b.get(i, 41)) for i in {*a, *b}}
    assert {i: r.rrf for i, r in got.items()} == pytest.approx(want) and all(0 <= r.normalised <= 1 for r in got.values())


def test_cap(spark):
    rows = [(1, 10, 1, None, "Same  text", 0.9), (1, 11, 1, None, "other", 0.8), (1, 12, 2, None, "same text", 0.7), (1, 13, 2, "p", "same text", 0.6), (1, 14, None, None, "", 0.5), (1, 15, None, None, "", 0.4)]
    pool = spark.createDataFrame(rows, "query_id long, id long, parent_id long, project string, content string, score double")
    keep = lambda cap: [(r.id, r.other_chunks) for r in retrieval.cap_per_parent(pool, 10, cap).orderBy("kept_rank").collect()]
    assert keep(1) == [(10, 1), (13, 1), (14, 0), (15, 0)] and keep(2) == [(10, 0), (11, 0), (13, 1), (14, 0), (15, 0)]


def test_top_k_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5) - 1, 1.0]) for i in range(60)], "id long, embedding array<double>")
    asked = rows.where("id < 20").withColumnRenamed("id", "query_id")
    whole = sorted(map(tuple, vectors.top_k(asked, rows, 3).collect()))
    monkeypatch.setattr(vectors, "BLOCK", 6)
    assert sorted(map(tuple, vectors.top_k(asked, rows, 3).collect())) == whole and len(whole) == 60
    zero = spark.createDataFrame([([0.0], [1.0]), ([2.0], [4.0])], "a array<double>, b array<double>")
    assert [r[0] for r in zero.select(vectors.cosine("a", "b")).collect()] == [0.0, 1.0]


def edges(spark, rows):
    df = spark.createDataFrame(rows, "source_id long, target_id long, relation string, note string, created_at string, expired_at string")
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "expired_at")})


def test_edges(spark):
    e = edges(spark, [(2, 1, "relates_to", "n", "2024-01-02", None), (1, 2, "relates_to", None, "2024-01-01", "2024-02-01"), (3, 1, "supports", "x", "2024-01-01", "2024-01-05"), (4, 4, "supports", None, "2024-01-01", None)])
    merged = {(r.source_id, r.target_id): r for r in graph.merge(e).collect()}
    assert set(merged) == {(1, 2), (3, 1)} and merged[1, 2].expired_at is None and str(merged[1, 2].created_at) == "2024-01-01 00:00:00" and merged[1, 2].note == "n"
    new = edges(spark, [(3, 1, "supports", None, "2024-03-01", None), (5, 5, "supports", None, "2024-03-01", None)])
    up = {(r.source_id, r.target_id): r for r in graph.upsert(e.where("source_id = 3"), new).collect()}
    assert set(up) == {(3, 1)} and up[3, 1].note == "x" and up[3, 1].expired_at is None
    again = graph.upsert(graph.upsert(e.where("source_id = 3"), new), new)
    assert sorted(map(str, again.collect())) == sorted(map(str, graph.upsert(e.where("source_id = 3"), new).collect()))
    mapped = graph.remap(e, spark.createDataFrame([(3, 2)], "id long, survivor long"))
    assert {(r.source_id, r.target_id, r.relation) for r in mapped.collect()} == {(1, 2, "relates_to"), (2, 1, "supports")}


def test_ingest_twice_changes_nothing(spark):
    stored = spark.createDataFrame([(1, "s", "u1", "old", ["a"], "p"), (2, "s", "u2", "same", None, "p")], "id long, source_type string, url string, content string, tags array<string>, project string")
    children = spark.createDataFrame([(10, 1, 0, "old", "active"), (20, 2, 0, "same", "active")], "id long, parent_id long, chunk_index int, content string, status string")
    staged = spark.createDataFrame([(0, "s", "u1", "first", ["b"], None), (1, "s", "u1", "new", ["b"], None), (2, "s", "u2", "same", ["c"], None), (3, "s", "u3", "third", None, "q")], "position long, source_type string, url string, content string, tags array<string>, project string")
    actions = store.ingest_actions(staged, stored)
    assert {(r.url, r.action, tuple(r.tags), r.project) for r in actions.collect()} == {("u1", "changed", ("a", "b"), "p"), ("u2", "unchanged", ("c",), "p"), ("u3", "new", (), "q")}
    pieces = actions.select("source_type", "url", F.lit(0).alias("chunk_index"), "content")
    rows, kids = store.next_snapshot(stored, children, actions, pieces)
    assert {(r.url, r.content) for r in rows.collect()} == {("u1", "new"), ("u2", "same"), ("u3", "third")}
    assert sorted((r.content, r.status) for r in kids.collect()) == [("new", "active"), ("old", "superseded"), ("same", "active"), ("third", "active")]
    assert {r.action for r in store.ingest_actions(staged, rows).collect()} == {"unchanged"}


def test_patch_merges_maps(spark):
    s = spark.createDataFrame([(1, "t", {"a": "1", "b": "2"}), (2, "u", None), (3, "v", {"z": "0"})], "id long, title string, meta map<string,string>")
    p = spark.createDataFrame([(1, None, {"b": "9", "c": "3"}), (2, "w", {"k": "v"})], "id long, title string, meta map<string,string>")
    got = {r.id: (r.title, r.meta) for r in store.patch(s, p, "id", ("meta",)).collect()}
    assert got == {1: ("t", {"a": "1", "b": "9", "c": "3"}), 2: ("w", {"k": "v"}), 3: ("v", {"z": "0"})}


@pytest.mark.parametrize("gone", [5, 26, 40])
def test_reconcile_guard(spark, gone):
    stored = spark.createDataFrame([(i, "p", "active") for i in range(100)] + [(200, "p", "retired"), (201, "p", "retired")], "id long, prefix string, status string")
    chosen = spark.createDataFrame([(i, 0.5) for i in range(gone, 100)] + [(200, 0.54), (201, 0.55), (300, 0.6), (301, 0.5)], "id long, confidence double")
    got = {r.id: r.decision for r in store.reconcile(stored, chosen).collect()}
    assert {got[i] for i in range(gone)} == ({"deleted"} if gone <= 25 else {"withheld"})
    assert (got[50], got[200], got[201], got[300], got[301]) == ("keep", "keep", "reactivate", "create", "keep")


def test_ids_in_text(spark):
    u = "01234567-89ab-cdef-0123-456789abcdef"
    rows = spark.createDataFrame([(1, f'{{"a": "{u.upper()}", "b": "{u}x"}}'), (2, None)], "id long, j string")
    assert [tuple(r) for r in store.ids_in_text(rows, "j", spark.createDataFrame([(u,)], "id string")).collect()] == [(1, u)]


@given(st.lists(st.one_of(st.none(), st.integers(1, 50)), min_size=1, max_size=12))
@settings(max_examples=5, deadline=None)
def test_quality_bounds(spark, ranks):
    df = spark.createDataFrame([(i, "c", r) for i, r in enumerate(ranks)], "query_id long, category string, rank long")
    q = evaluation.quality(df).first()
    assert 0 <= q.mrr <= 1 and q.hit_1 <= q.hit_3 <= q.hit_5 <= q.hit_10 <= 1 and q.found == sum(r is not None for r in ranks)
    assert q.mrr == pytest.approx(sum(1 / r for r in ranks if r) / len(ranks), abs=1e-6)


def test_tau(spark):
    order = lambda *ids: spark.createDataFrame([(1, i, n) for n, i in enumerate(ids, 1)], "query_id long, id long, rank long")
    tau = lambda a, b: evaluation.kendall_tau(order(*a), order(*b)).first().tau
    assert tau((1, 2, 3), (1, 2, 3)) == 1.0 and tau((1, 2, 3), (3, 2, 1)) == -1.0 and tau((1, 2, 3), (1, 2, 4)) == -1.0
    assert tau((1, 2, 3), (1, 3, 2)) == pytest.approx(1 / 3, abs=1e-6)


def test_quotas(spark):
    counts = spark.createDataFrame([("a", 100), ("b", 4), ("c", 1), ("d", 0)], "channel string, n long")
    got = {r.channel: r.quota for r in ledger.stratified(counts, 10, 6).collect()}
    assert got["c"] == 1 and "d" not in got and got["a"] <= 6 and got["b"] <= 4


def test_listing(spark):
    rows = spark.createDataFrame([(1, "p", "active"), (2, None, "active"), (3, "q", "superseded"), (4, "p", None)], "id long, project string, status string")
    assert {r.id for r in corpus.where(rows, project="p").collect()} == {1, 2, 4}
    assert {r.id for r in rows.where(corpus.not_history(F.col("id"), F.col("status"))).collect()} == {1, 2, 4}

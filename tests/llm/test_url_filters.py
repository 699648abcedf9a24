"""URL rules against plain string work; mined rules against counts of all token combinations."""

import itertools
import random
from collections import Counter

import duckdb

from lorewell.llm import catalog, url_filters

SCHEMA = "page_id long, url string, html string, host string, path string, tokens string, by string, verdict string"


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "h", "a", "b", "c", "d", "e") for i, u in enumerate(urls)], SCHEMA)


def plain_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    end = min([rest.find(c, cut) for c in "?#" if rest.find(c, cut) >= 0], default=len(rest))
    return host, rest[cut:end]


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    "http://a.example.org/es/1", "http://example.org/en/17", "https://EXAMPLE.org/en/2", "http://notexample.org/es/", "http://example.org.evil.net/es/", "http://x.com/fr/9?u=1", "http://x.com/de/9#t", "http://x.com/DE/9",
    "http://com/de/", "http://org", "http://org?x=/y", "ftp://a.org/#/es/", "mailto:a@b.org", "", None, "://", "http://a.net/b://c.org/", "http://x.com/fr", "http://ÄX.org/", "http://a.org\n/es/", "x" * 200_000, "http://a.com/" + "w/" * 50_000,
]


def test_rules_hosts_and_paths(spark):
    rows = url_filters.judge(frame(spark, URLS * 2)).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        url = (URLS * 2)[r.page_id]
        host, path = plain_parts(url)
        rule, verdict = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_mined_rules(spark):
    sets = [({"a", "b", "c"}, "block")] * 6 + [({"a", "b"}, "allow")] * 5 + [({"c", "d"}, "block")] * 7 + [({"d"}, "allow")] * 2 + [({"e"}, "block")] + [(set(), "allow")] * 3
    counts, times = Counter(), Counter()
    for tokens, verdict in sets:
        for k in range(1, len(tokens) + 1):
            for part in itertools.combinations(sorted(tokens), k):
                counts[part, verdict] += 1
                times[part] += 1
    sure = {(p, v): n / times[p] for (p, v), n in counts.items() if n >= 0.1 * len(sets) and n / times[p] >= 0.7}
    want = {(p, v): c for (p, v), c in sure.items() if not any(sure.get((tuple(x for x in p if x != gone), v), 0) >= c for gone in p)}
    df = spark.createDataFrame([(sorted(t), v) for t, v in sets], "tokens array<string>, verdict string")
    rules = url_filters.mined_rules(df, 0.1, 0.7).collect()
    assert {(tuple(r.tokens), r.verdict): r.confidence for r in rules} == want
    assert all((r.n, r.key) == (counts[tuple(r.tokens), r.verdict], min(r.tokens, key=lambda x: (times[(x,)], x))) for r in rules)
    assert url_filters.mined_rules(df.limit(0)).collect() == []


def test_all_tokens_of_long_urls_are_mined(spark):
    rng, names = random.Random(4), [f"t{i:02}" for i in range(12)]
    sets = [({x for x in names if rng.random() < 0.7} | {"all", "every"} | ({"twin", "rare"} if i % 3 == 0 else set()), "block" if i % 3 == 0 and i % 4 else rng.choice(["allow", "allow", "block"])) for i in range(30)]
    sets = [(tokens | ({"sure"} if verdict == "block" and i % 2 else set()), verdict) for i, (tokens, verdict) in enumerate(sets)]
    assert max(len(tokens) for tokens, _ in sets) > 12
    counts, times = Counter(), Counter()
    for tokens, verdict in sets:
        for k in range(1, len(tokens) + 1):
            for part in itertools.combinations(sorted(tokens), k):
                counts[part, verdict] += 1
                times[part] += 1
    sure = {(p, v): n / times[p] for (p, v), n in counts.items() if n >= 0.2 * len(sets) and n / times[p] >= 0.7}
    want = {(p, v): c for (p, v), c in sure.items() if not any(sure.get((tuple(x for x in p if x != gone), v), 0) >= c for gone in p)}
    assert any(x in p for p, _ in want for x in ("twin", "rare")) and (("sure",), "block") in want
    df = spark.createDataFrame([(sorted(t), v) for t, v in sets], "tokens array<string>, verdict string")
    rules = url_filters.mined_rules(df, 0.2, 0.7).collect()
    assert len(rules) == len(want) and {(tuple(r.tokens), r.verdict): r.confidence for r in rules} == want
    assert all((r.n, r.key) == (counts[tuple(r.tokens), r.verdict], min(r.tokens, key=lambda x: (times[(x,)], x))) for r in rules)


def test_a_rare_token_of_a_long_url_decides(spark):
    path = "/".join("abcdefghijkl")
    judged = spark.createDataFrame([(f"http://x.net/{path}/{'win' if i % 5 == 0 else 'z'}", "block" if i % 5 == 0 else "allow") for i in range(40)], "url string, verdict string")
    got = {r.page_id: r.verdict for r in url_filters.judge(frame(spark, ["http://y.net/win", f"http://x.net/{path}/z", f"http://x.net/{path}/win"]), judged=judged).collect()}
    assert got == {0: "block", 1: "allow", 2: "block"}


def test_judging_by_given_labels(spark):
    judged = spark.createDataFrame([(f"http://s{i}.casino-win.net/x/{i}", "block") for i in range(20)] + [(f"https://blog.good{i % 3}.net/en/{i}", "allow") for i in range(20)] + [(None, "allow"), ("http://a.net", None)], "url string, verdict string")
    urls = ["http://m.casino-win.biz/p/5", "https://blog.other.biz/en/1", "gopher://nothing.like.it/", None, "http://casino-win.org/"]
    got = {r.page_id: (r.verdict, r.rule) for r in url_filters.judge(frame(spark, urls), judged=judged).collect()}
    assert got == {0: ("block", None), 1: ("allow", None), 2: ("allow", None), 3: ("allow", None), 4: ("allow", "org/")}
    assert url_filters.judge(frame(spark, [])).collect() == []


def test_like_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    df = catalog.queries()["op13_url_filters"](spark, "/root/testdata/sf0.001")
    cursor = con.execute(catalog.oracle_sql()["op13_url_filters"])
    assert [c[0] for c in cursor.description] == df.columns
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


def test_no_python_in_the_plan(spark):
    plan = url_filters.judge(frame(spark, URLS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

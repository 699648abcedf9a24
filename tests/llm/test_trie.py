"""The trie of conversations against a plain dictionary of prefixes, on odd rows too."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from lorewell.llm import catalog, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, name string, depth int, idx int, node string"


def expected(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[c].append((t is not None, t or 0, key, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    made = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(c / 5) * 5
        made[c] = own.get(c - base, [])[:h] + own[c][h:]
    nodes, ends = defaultdict(list), defaultdict(list)
    for c, seq in made.items():
        ends[tuple(seq)].append(c)
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    out = set()
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below) for q in below)
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        hashed = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.add((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids), leaves, saved, hashed))
    return out


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA)
    got = [tuple(r) for r in prefix_trie.prefix_nodes(df).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_random_conversations(spark):
    for seed in range(3):
        rng, rows = random.Random(seed), []
        for c in rng.sample(range(-12, 40), 30):
            for t in range(rng.choice([1, 2, 3, 5, 9, 17])):
                rows.append((c, rng.choice([None, t, t, 3]), rng.choice(["user", "user", None]), rng.choice(["a", "é", "", None, "long " * 50])))
        rows += [rows[0], rows[0], (None, 1, "user", "lost")]
        assert found(spark, rows) == expected(rows)


def test_many_copies_and_one_very_long(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 300) for t in range(3)] + [(1005, t, "user", f"turn {t % 7}") for t in range(700)] + [(1006, 0, "user", "x")] * 40
    assert found(spark, rows) == expected(rows)


def test_no_conversations(spark):
    assert found(spark, []) == set() == found(spark, [(None, 1, "user", "x")])
    assert found(spark, [(7, None, None, None)]) == expected([(7, None, None, None)])


def test_runs_of_members_are_hashed_like_one_text(spark):
    ids = list(range(-50, 25_000))
    ends = spark.createDataFrame([(i,) for i in ids], "conv_id long").select(F.lit(1).cast("long").alias("depth"), F.lit(-50).cast("long").alias("node"), "conv_id")
    (row,) = prefix_trie.end_hashes(ends.repartition(7)).collect()
    assert row.ends == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_like_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    df = catalog.queries()["op11_prefix_trie"](spark, "/root/testdata/sf0.001")
    cursor = con.execute(catalog.oracle_sql()["op11_prefix_trie"])
    assert [c[0] for c in cursor.description] == df.columns
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(cursor.fetchall(), key=repr)

"""Near-duplicates by five-word shingles against all pairs, planted copies and odd ids."""

import corpus_pipeline
import numpy as np

from lorewell.llm import resemblance, simhash
from lorewell.llm.shared import LOWER


def plain_set(text):
    words = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_kept(rows):
    """Sets of a group's kept row by brute force: groups of similar sets, each with its smallest doc_id."""
    sets = sorted({plain_set(t) for _, t in rows}, key=sorted)
    group = list(range(len(sets)))
    for x in range(len(sets)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if 5 * both >= 4 * (len(sets[x]) + len(sets[y]) - both) and group[x] != group[y]:
                a, b = group[x], group[y]
                group = [b if g == a else g for g in group]
    at, least = dict(zip(sets, group, strict=True)), {}
    for i, t in rows:
        g = at[plain_set(t)]
        least[g] = min(least.get(g, (True, 0)), (i is None, i or 0))
    return sorted(least.values())


def test_stage_keeps_one_of_each_planted_group(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for base in range(60):
        words = [f"w{x}" for x in rng.integers(0, 30_000, rng.integers(80, 300))]
        for copy in range(4):
            own = list(words)
            for at in rng.choice(len(own), len(own) * copy // 120, replace=False):
                own[at] = f"new{base}x{copy}x{at}"
            rows.append((n, " ".join(own)))
            n += 1
    rows += [(None, "a text without an id"), (None, "quite another one without an id"), (7000, "the same id twice here"), (7000, "but another text for it"), (7001, None), (7002, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = lambda: sorted((r.doc_id is None, r.doc_id or 0) for r in corpus_pipeline.one_of_each(spark, docs, "").collect())
    assert kept() == plain_kept(rows)
    monkeypatch.setattr(resemblance, "BLOCK_SHINGLES", 400)
    assert kept() == plain_kept(rows)


def test_blocks_find_what_one_task_finds():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 200, np.uint64)
    sets = [np.unique(np.r_[base[: 200 - k], rng.integers(0, 2**63, k, np.uint64)]) for k in range(0, 60, 3)]
    fps = np.array([simhash.majority(s) for s in sets], np.uint64)
    near = {(a, b) for a in range(20) for b in range(20) if resemblance.similarity(sets[a], sets[b]) >= 0.8}
    found = list(resemblance.links(fps, np.arange(20), sets, np.ones(20, bool), np.ones(20, bool)))
    assert found and set(found) <= near


def test_groups_decide_not_ids(spark, documents):
    odd = spark.createDataFrame([(None, "one text with no id"), (None, "other words with no id at all"), (7, "first text of seven"), (7, "something else under the id"), (3, "first text of seven")], "doc_id long, text string")
    texts = lambda df: sorted(r.text for r in df.collect())
    for one_of_each in (simhash.one_of_each, resemblance.one_of_each):
        assert texts(one_of_each(odd)) == ["first text of seven", "one text with no id", "other words with no id at all", "something else under the id"]
        assert one_of_each(documents).columns == documents.columns and one_of_each(documents).where("doc_id is null").count() == 1

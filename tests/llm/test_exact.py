"""Operators held against plain versions on small data, odd rows included."""

import math
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from lorewell.llm import components, embedding_dedup, licenses, mixing, pieces, sharding, simhash, topk
from lorewell.llm.shared import LOWER

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(2000, 2300)]
    edges_between = [e for e in edges if e[0] != e[1]]
    want = groups(edges_between, {x for e in edges_between for x in e})
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_permutation(n):
    assert sorted(sharding.permute(np.arange(n), n, 7).tolist()) == list(range(n))


def test_sharding(documents, no_documents):
    rows = sharding.shard_documents(documents).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(rows) == documents.count() and max(map(len, by.values())) - min([*map(len, by.values())] + [0] * (16 - len(by))) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, sharding.shard_documents(documents.repartition(5)).collect()))
    assert sharding.shard_documents(no_documents).count() == 0


def plain_place(x, n, seed=7, rounds=6):
    """The same permutation, number by number with plain integers."""
    half = 1
    while 4**half < n:
        half += 1
    keys, full = np.random.default_rng(seed).integers(0, 2**63, rounds, dtype=np.uint64).tolist(), 2**64 - 1
    while True:
        left, right = x >> half, x & (2**half - 1)
        for key in keys:
            m = (right ^ key) * 0x9E3779B97F4A7C15 & full
            m = (m ^ (m >> 29)) * 0xBF58476D1CE4E5B9 & full
            left, right = right, left ^ ((m ^ (m >> 32)) & (2**half - 1))
        x = left << half | right
        if x < n:
            return x


def test_shards_and_slots_follow_from_the_ids(documents, small):
    for docs in (documents, small("documents")):
        own = []
        for r in docs.collect():
            data = (r.text or "").encode()
            crc, size = zlib.crc32(data), len(data) + 1
            key = "\x1f".join(["\x00" if r.doc_id is None else str(r.doc_id), str(crc), str(size)])
            h = xxhash.xxh64_intdigest(key.encode(), 42)
            own.append(((h - (h >> 63 << 64)) % 1024, r.doc_id is not None, r.doc_id or 0, crc, size))
        want = sorted((x[2] if x[1] else -1, x[4], x[3], plain_place(n, len(own)) % 16, plain_place(n, len(own)) // 16) for n, x in enumerate(sorted(own)))
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shard_documents(docs).collect())
        assert got == want


def plain_fingerprint(text):
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(documents, small):
    texts = {r.text for r in documents.collect()} | {r.text for r in small("documents").collect()}
    assert any(len(t or "") > 99_999 for t in texts)
    for text in texts:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("distance", [1, 2, 4, 6])
def test_pigeonring_finds_all(distance):
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = [base]
    for center, copies in ((base[0], 300), *((c, 6) for c in base[1:30])):
        for _ in range(copies):
            x = center
            for b in rng.choice(64, rng.integers(0, distance + 2), replace=False):
                x ^= np.uint64(1) << np.uint64(b)
            fps.append(np.array([x]))
    fps = np.unique(np.concatenate(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
    at = {int(x): i for i, x in enumerate(fps)}
    found = [(at[int(a)], at[int(b)]) for x, y in simhash.linked(*simhash.keyed(fps, distance), distance) for a, b in zip(x, y, strict=True)]
    assert all(near[a, b] for a, b in found)
    assert groups(found, range(len(fps))) == groups(np.argwhere(near).tolist(), range(len(fps)))


def crowd(n, seed, spread=6):
    """Fingerprints around a few centres that agree in their first 26 bits."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**38, 40, dtype=np.uint64) << np.uint64(26) | np.uint64(12345)
    fps = centres[rng.integers(0, 40, n)]
    for _ in range(spread):
        fps = fps ^ (np.uint64(1) << rng.integers(20, 64, n).astype(np.uint64))
    return np.unique(np.concatenate([fps, centres]))


def same_groups(fps, found, distance=4):
    at = {int(x): i for i, x in enumerate(fps)}
    near = [(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= distance).tolist() if i < j]
    pairs = [(at[int(a)], at[int(b)]) for a, b in found]
    assert all((int(a) ^ int(b)).bit_count() <= distance for a, b in found)
    return groups(pairs, range(len(fps))) == groups(near, range(len(fps)))


@pytest.mark.parametrize("n", [300, 2500])
def test_crowded_keys(spark, monkeypatch, n):
    fps = crowd(n, n)
    monkeypatch.setattr(simhash, "PAIRS", 500)
    key, own, probe = simhash.keyed(fps, 4)
    assert same_groups(fps, [p for x, y in simhash.linked(key, own, probe, 4) for p in zip(x, y, strict=True)])
    order = np.lexsort((probe, key))
    rows = [(key[k], np.zeros(len(k), np.int32), own[k], probe[k]) for k in np.array_split(order, 60)]
    monkeypatch.setattr(simhash, "ROWS", 200)
    assert same_groups(fps, [p for x, y in simhash.met(iter(rows), 4) for p in zip(x, y, strict=True)])
    monkeypatch.setattr(simhash, "BLOCK", 64)
    links = simhash.near_links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")).collect()
    assert same_groups(fps, np.array([(r.a, r.b) for r in links], np.int64).view(np.uint64).reshape(-1, 2))


def test_near_duplicates(documents, no_documents, small):
    for docs in (documents, small("documents")):
        rows = simhash.near_duplicates(docs).collect()
        texts = [(r.doc_id, r.text) for r in docs.collect()]
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in texts)
        fps = {i: int(next(r.fingerprint for r in rows if r.doc_id == i), 16) for i, _ in texts if i is not None}
        ids = sorted(fps)
        want = groups([(a, b) for a in ids for b in ids if (fps[a] ^ fps[b]).bit_count() <= 4], ids)
        assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == want
    kept = simhash.one_of_each(documents)
    assert kept.columns == documents.columns and kept.where("doc_id = 7").count() == 1 and kept.where("doc_id in (2, 3)").count() == 0
    assert simhash.near_duplicates(no_documents).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(1)
    rows = []
    for label in range(3):
        for _ in range(120):
            v = rng.standard_normal(16)
            rows += [(v + 0.02 * rng.standard_normal(16) * rng.random(), label) for _ in range(rng.integers(1, 4))]
    hot = rng.standard_normal(16)
    rows += [(hot + 0.01 * rng.standard_normal(16), 1) for _ in range(700)] + [(hot, 1)] * 30 + [(hot * 3, 1)] * 2 + [(hot, None), (hot, 2)]
    rows = [(n, [float(np.float32(x)) for x in v], label) for n, (v, label) in enumerate(rows)]
    odd = [[0.0] * 16, None, [], [1.0, None], [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0]]
    rows += [(10_000 + n, v, 1) for n, v in enumerate(odd)]
    df = spark.createDataFrame([r + ("x",) for r in rows], "vec_id long, embedding array<float>, label int, rep string")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect()}
    links = defaultdict(set)
    ok = [(i, np.array(v), label) for i, v, label in rows if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for label in range(3):
        for size in (2, 16):
            own = [(i, v / np.linalg.norm(v)) for i, v, lab in ok if lab == label and len(v) == size]
            if own:
                m = np.array([v for _, v in own])
                for a, b in np.argwhere(m @ m.T >= 0.98).tolist():
                    if a != b:
                        links[own[a][0]].add(own[b][0])
    want = groups([(a, b) for a in links for b in links[a]], [i for i, *_ in rows])
    assert sorted(got) == [i for i, *_ in rows]
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (len(links[i]), want[i], want[i] == i) for i, *_ in rows}
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_recall_of_the_index(small):
    rows = small("embeddings").collect()
    vectors = embedding_dedup.units([r.embedding for r in rows])
    index = embedding_dedup.MultiIndex(vectors, 640 * 100, 0.98, 0.99)
    noise = np.random.default_rng(8).standard_normal(vectors.shape)
    noise -= (noise * vectors).sum(1, keepdims=True) * vectors
    turned = 0.98 * vectors + (1 - 0.98**2) ** 0.5 * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    found = [(own[0] in other) if own[0] >= other[0] else (other[0] in own) for own, other in zip(index.cells(turned), index.cells(vectors), strict=True)]
    assert np.mean(found) >= 0.95 and max(map(len, index.cells(vectors))) < 100


def test_top_k(spark, small):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(8) * rng.choice([0.1, 1, 30])]) for i in range(1, 400)]
    rows += [(400, rows[3][1]), (450, [0.0] * 8), (500, None), (550, [1.0, None] + [0.0] * 6), (600, [float("nan")] * 8), (650, [2.0] * 3), (651, [2.0] * 3), (700, []), (701, []), (None, [1.0] * 8)]
    df = spark.createDataFrame([r + (1,) for r in rows], "vec_id long, embedding array<float>, score int")
    good = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in good if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:5])}
    assert {tuple(r) for r in topk.top_k(df).collect()} == want
    assert topk.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("threshold", [-0.2, 0.3, 0.7, 0.95])
def test_coordinate_pruning_is_safe(threshold):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for q in x[:20]:
        assert not ((x @ q >= threshold) & ~topk.feasible(x, q, threshold)).any()


def plain_fill(sizes, weights, share, epochs):
    targets, capped, left = dict.fromkeys(sizes, 0.0), set(), share * sum(sizes.values())
    while len(capped) < len(sizes):
        room = sum(w for s, w in weights.items() if s not in capped)
        over = {s for s in sizes if s not in capped and left * weights[s] / room > epochs * sizes[s]}
        if not over:
            return targets | {s: left * weights[s] / room for s in sizes if s not in capped}
        for s in over:
            targets[s] = epochs * sizes[s]
        capped |= over
        left = share * sum(sizes.values()) - sum(targets[s] for s in capped)
    return targets


def test_mixing(spark, documents, no_documents, small):
    for docs in (documents, small("documents")):
        rows = mixing.mix_documents(docs).collect()
        size = {(r.doc_id, r.text): len((r.text or "").encode().split()) for r in docs.collect()}
        assert sorted(r.size for r in rows) == sorted(size[r.doc_id, r.text] for r in docs.collect())
        sizes = Counter()
        for r in rows:
            sizes[r.source] += r.size
        order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
        want = plain_fill({s: sizes[s] for s in order}, {s: (3, 1, 2)[n % 3] for n, s in enumerate(order)}, 1.5, 2.0)
        taken = Counter()
        for r in rows:
            taken[r.source] += r.taken
            assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        assert all(want[s] - 1 - sum(r.source == s for r in rows if r.doc_id in (None, 7)) <= taken[s] <= want[s] + 1e-6 for s in order)
        assert all(len({(r.doc_id, r.size) for r in rows if r.source == s and r.size and r.taken % r.size}) <= 1 for s in order)
        mixed = mixing.take(docs)
        assert mixed.columns == docs.columns and sum(len(r.text.encode().split()) for r in mixed.collect()) == sum(taken.values())
    assert sorted(map(str, mixing.mix_documents(documents).collect())) == sorted(map(str, mixing.mix_documents(documents.repartition(3)).collect()))
    assert mixing.mix_documents(no_documents).count() == 0 and mixing.take(no_documents).count() == 0


def test_pieces(documents, no_documents):
    e = pieces.encoder(pieces.model_bytes(MODEL))
    scores = {p: (s, i) for i, (p, s, kind) in enumerate(e.pieces) if kind == pieces.NORMAL}

    def plain(text):
        best = [(0.0, [])] + [None] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - 16), end):
                if (own := scores.get(text[start:end])) and best[start] and (best[end] is None or best[start][0] + own[0] > best[end][0]):
                    best[end] = (best[start][0] + own[0], best[start][1] + [own[1]])
            if best[end] is None or (text[end - 1] not in scores and best[end - 1][0] + e.floor > best[end][0]):
                best[end] = (best[end - 1][0] + e.floor, best[end - 1][1] + [e.bytes[b] for b in text[end - 1].encode()])
        return best[-1][1]

    for text in ["Hello  world", "naïve café\n\n  x", "漢字 and \U0001f600\U0001f680", "a" * 50, " lead", "the international organisation's", "\t", "ꙮꙮ꙯"]:
        assert e.encode(text) == list(e.search(e.normal(text)))
        assert sum(e.pieces[i][1] for i in e.encode(text)) == pytest.approx(sum(e.pieces[i][1] for i in plain(e.normal(text)))) and e.decode(e.encode(text)) == text
        assert e.encode(text) == plain(e.normal(text))
    rows = pieces.encode_documents(documents, MODEL)
    assert rows.count() == documents.count() and {r.doc_id for r in rows.collect() if not r.exact} == {11}
    back = {(r.doc_id, r.text) for r in pieces.decode_documents(rows, MODEL).collect()}
    assert back == {(r.doc_id, (r.text or "").replace("▁", " ")) for r in documents.collect()}
    assert pieces.encode_documents(no_documents, MODEL).count() == 0


def test_pieces_without_byte_pieces_or_prefix():
    e = pieces.Encoder([("<unk>", 0.0, 2), ("a", -1.0, 1), ("b", -1.0, 1), ("ab", -1.5, 1), ("b▁a", -0.5, 1), ("▁", -2.0, 1)], prefix=False)
    assert not e.separable and e.encode("ab a") == [1, 4] and e.encode("aza") == [1, 0, 1] and e.encode("") == []


def plain_scan(text):
    words = (text or "").encode().translate(licenses.TABLE).split()
    places = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.encode().split()]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_licenses(spark, documents, no_documents, small):
    own = spark.createDataFrame([(1, "cc by nc cc by nc under the MIT license; apache-license, version 2 " * 50), (2, "Relased undr the MIT license"), (3, "All right reserved"), (4, "x" * 200_000)], "doc_id long, text string")
    for docs in (documents, small("documents"), own):
        texts = {r.doc_id: r.text for r in docs.collect()}
        rows = licenses.scan_licenses(docs).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_scan(texts[r.doc_id])
            assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    found = {r.doc_id: r for r in licenses.scan_licenses(own).collect()}
    assert found[2].labels == "mit" and found[2].base_labels == "" and found[3].labels == "all-rights-reserved" and found[3].spans[0].edits == 1
    for r in found.values():
        text = own.where(f"doc_id = {r.doc_id}").first().text
        assert all(s.text == text[s.start : s.end] for s in r.spans) and all(s.first <= r.n_words for s in r.spans)
    assert licenses.scan_licenses(no_documents).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_labels(s, line):
    """Labels of all runs of whole words within a notice's edits that hold the words it must keep."""
    words, out = line.split(" "), set()
    for notice, label, most, kept in s.notices:
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                own = " ".join(words[i:j])
                if abs(len(own) - len(notice)) <= most and all(w in words[i:j] for w in kept) and distance(own, notice) <= most:
                    out.add(label)
    return out


def edited(rng, text, times):
    letters = list("abcdefgimnorstu 2")
    for _ in range(times):
        at, kind = rng.integers(0, len(text)), rng.integers(3)
        text = text[:at] + ("" if kind == 1 else str(rng.choice(letters))) + text[at + (kind != 0) :]
    return " ".join(text.split())


def test_fuzzy_matches_are_those_of_brute_force():
    s, rng = licenses.scanner(), np.random.default_rng(4)
    around = ["foo", "all", "the", "license", "rights", "cc", "by", "under", "public", "baz"]
    for n in range(700):
        notice, _, most, _ = s.notices[n % len(s.notices)]
        before, after = (" ".join(rng.choice(around, rng.integers(0, 4))) for _ in range(2))
        line = " ".join(f"{before} {edited(rng, notice, rng.integers(0, most + 2))} {after}".split())
        assert {x[2] for x in s.fuzzy(line)} == plain_labels(s, line), line
    for line in ("foo all sall rights reserved", "foo sall rights reserved bar baz", "apache licence version 2 0", "distributed under the mit licence"):
        assert len(s.fuzzy(line)) == 1, line
    for line in ("released under the bit license", "licensed under the apache license version 1", "creative commons attribution commercial", "cc by sa"):
        assert not s.fuzzy(line), line


def test_long_repeats_take_time_in_proportion():
    s, began = licenses.scanner(), time.perf_counter()
    out = s.scan("cc by nc " * 550_000)
    assert out["n_base"] == 550_000 and out["last_word"] == 3 * 549_999 and time.perf_counter() - began < 10

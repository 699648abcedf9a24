"""The Pitman-Yor model against a plain sampler that moves one customer at a time, its sums, and odd rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lorewell.llm import grams, language_model, seating
from lorewell.llm.shared import LOWER

D = (0.7, 0.6, 0.5)


class Plain:
    """Restaurants of contexts ('b', 'a'), ('b',) and (): lists of table sizes for each dish."""

    def __init__(self, words):
        self.seats, self.words, self.rng = defaultdict(lambda: defaultdict(list)), words, random.Random(5)

    def p(self, context, w):
        d, here = D[2 - len(context)], self.seats[context]
        below = self.p(context[:-1], w) if context else 1 / (self.words + 1)
        tables = sum(map(len, here.values()))
        own = here.get(w, [])
        return (sum(own) - d * len(own) + (1 + d * tables) * below) / (1 + sum(map(sum, here.values())))

    def enter(self, context, w):
        d, here = D[2 - len(context)], self.seats[context]
        below = self.p(context[:-1], w) if context else 1 / (self.words + 1)
        new = (1 + d * sum(map(len, here.values()))) * below
        at = self.rng.random() * (sum(here[w]) - d * len(here[w]) + new) - new
        if at < 0:
            here[w].append(1)
            if context:
                self.enter(context[:-1], w)
            return
        for k, size in enumerate(here[w]):
            at -= size - d
            if at < 0 or k == len(here[w]) - 1:
                here[w][k] += 1
                return

    def leave(self, context, w):
        here = self.seats[context][w]
        k = self.rng.choices(range(len(here)), here)[0]
        here[k] -= 1
        if not here[k]:
            del here[k]
            if context:
                self.leave(context[:-1], w)

    def tables(self):
        n = [0, 0, 0]
        for context, dishes in self.seats.items():
            n[2 - len(context)] += sum(map(len, dishes.values()))
        return np.array(n)


def corpus():
    rng = np.random.default_rng(3)
    follow = [rng.dirichlet(np.full(12, 0.25)) for _ in range(12)]
    out = []
    for _ in range(90):
        words, at = [], int(rng.integers(12))
        for _ in range(int(rng.integers(4, 14))):
            at = int(rng.choice(12, p=follow[at]))
            words.append(f"w{at}")
        out.append(" ".join(words))
    return out


def split_texts(texts, parts, limit=None):
    """Ranges of the texts' trigrams, all of them for training, and the dictionary."""
    words = [grams.hashed(t) for t in texts]
    every, counts = np.unique(np.concatenate(words), return_counts=True)
    dictionary = grams.Dictionary(np.append(every, np.uint64(2)), np.append(counts, len(texts)), int(counts.sum()))
    if limit:
        dictionary.limit = limit
    slices = list(grams.slices(words, np.ones(len(texts), bool), 0, dictionary, parts))
    return [language_model.Range(r, [types], dictionary) for r, types, _ in slices], dictionary, sum(map(len, words))


def exchanged(ranges, parts, dictionary, before, turn):
    answers, sums = defaultdict(dict), Counter()
    ups = {r.number: dict(r.up(parts)) for r in ranges}
    for o in range(parts):
        asking = sorted(n for n in ups if o in ups[n])
        out, rows = language_model.shared_seats(o, parts, [ups[n][o] for n in asking], dictionary, before, turn) if asking else ([], [])
        for n, data in zip(asking, out, strict=True):
            answers[n][o] = data
        for name, x, y in rows:
            sums[name] += np.array([x, y])
    totals = language_model.Totals([(name, *map(int, xy)) for name, xy in sums.items()])
    totals.discounts = D
    for r in ranges:
        r.down(answers[r.number], parts, totals)
    return totals


@pytest.fixture(scope="module")
def plain():
    """Mean tables of the three levels, and mean probabilities of all the corpus's trigrams."""
    tokens = []
    for t in corpus():
        words = [*t.split(), ""]
        before = ["<", "<", *words[:-1]]
        tokens += [((b, a), w) for a, b, w in zip(before, before[1:], words, strict=False)]
    model = Plain(len({w for _, w in tokens}))
    for context, w in tokens:
        model.enter(context, w)
    tables, mean, kept, types = np.zeros(3), Counter(), 0, sorted(set(tokens))
    for sweep in range(700):
        for context, w in tokens:
            model.leave(context, w)
            model.enter(context, w)
        if sweep >= 20:
            kept, tables = kept + 1, tables + model.tables()
            for context, w in types:
                mean[context, w] += model.p(context, w)
    return tables / kept, {k: v / kept for k, v in mean.items()}


@pytest.mark.parametrize(("parts", "limit"), [(1, None), (3, 60)])
def test_long_chains_agree_with_a_plain_sampler(plain, parts, limit):
    want, probabilities = plain
    ranges, dictionary, _ = split_texts(corpus(), parts, limit)
    assert len(ranges) == parts and (limit is None or len(dictionary.split()) >= 2)
    totals, tables, kept = None, np.zeros(3), 0
    hashes = {w: grams.hashed(w)[0] if w else np.uint64(1) for w in {x for (b, a), w in probabilities for x in (a, b, w)}} | {"<": np.uint64(2)}
    mean = Counter()
    for r in ranges:
        r.guess(parts)
        r.totals.discounts = D
    for turn in range(260):
        for r in ranges:
            r.sweep(np.random.default_rng((turn, r.number)))
        totals = exchanged(ranges, parts, dictionary, totals, turn)
        if turn >= 20:
            kept += 1
            shared = {int(b): t for b, (_, t) in totals.shared.items()}
            own = sum(int(r.t2[~r.shared].sum()) for r in ranges)
            tables += [sum(int(r.t3.sum()) for r in ranges), own + sum(shared.values()), totals.tables]
            for r in ranges:
                names = r.of_context[r.pair], r.words[r.word[r.pair]]
                for b, w, o, p in zip(*map(np.ndarray.tolist, names), r.outer.tolist(), r.predictive().tolist(), strict=True):
                    mean[r.number, b, w, o] += p
    assert (np.abs(tables / kept / want - 1) < [0.05, 0.05, 0.08]).all()
    theirs, own = defaultdict(list), defaultdict(list)
    for ((b, a), w), p in probabilities.items():
        theirs[int(hashes[b]), int(hashes[w])].append(math.log10(p))
    for (_, b, w, _), p in mean.items():
        own[b, w].append(math.log10(p / kept))
    assert set(own) == set(theirs) and all(len(own[k]) == len(theirs[k]) for k in own)
    apart = np.array([x - y for k in own for x, y in zip(sorted(own[k]), sorted(theirs[k]), strict=True)])
    assert abs(apart.mean()) < 0.01 and np.sqrt((apart**2).mean()) < 0.03


@pytest.mark.parametrize("discount", [0.5, 0.75, 0.85])
def test_table_counts_follow_their_distribution(discount):
    for n in (2, 7, 64, 200, 900):
        logs = np.full(n + 2, -np.inf)
        logs[1], t = 0.0, np.arange(n + 2)
        for k in range(1, n):
            logs[1:] = np.logaddexp(logs[:-1], logs[1:] + np.log(np.maximum(k - discount * t[1:], 1e-300)))
        for rate, others in ((-6.0, None), (-1.0, None), (1.0, None), (3.0, None), (-3.0, 4.0)):
            t = np.arange(1, n + 1)
            log_p = logs[1 : n + 1] + (t - 1) * rate + (0 if others is None else seating.log_gamma(others + t) - seating.log_gamma(np.array(others + 1)))
            p = np.exp(log_p - log_p.max())
            p /= p.sum()
            mean, deviation = p @ t, np.sqrt(p @ t**2 - (p @ t) ** 2)
            drawn = seating.draw(np.full(3000, n), np.full(3000, rate), None if others is None else np.full(3000, others), discount, np.random.default_rng(1))
            assert drawn.min() >= 1 and drawn.max() <= n and drawn.mean() == pytest.approx(mean, rel=0.05, abs=4 * deviation / 3000**0.5 + 1e-9), (n, rate)


def test_a_frequent_pair_gets_all_its_tables():
    # a thousand customers, discount 0.75 and a new table worth 0.385: a long chain has 1.97 tables
    drawn = seating.draw(np.full(5000, 1000), np.full(5000, math.log(0.385)), None, 0.75, np.random.default_rng(0))
    assert 1.4 < drawn.mean() < 2.1


def test_probabilities_sum_to_one():
    ranges, dictionary, _ = split_texts(corpus(), 1)
    (own,) = ranges
    own.guess(1)
    own.sweep(np.random.default_rng(1))
    totals = exchanged(ranges, 1, dictionary, None, 0)
    own.sweep(np.random.default_rng(2))
    d3, d2, _ = totals.discounts
    tables, c2, t2 = own.levels()
    root = totals.root(own.root_n, own.root_t)
    assert root.sum() + totals.root(np.zeros(1), np.zeros(1))[0] == pytest.approx(1)
    for outer in range(0, len(own.c3), 17):
        here = np.flatnonzero(own.outer == outer)
        b = own.context[own.pair[here[0]]]
        middle = (1 + d2 * t2[b]) * np.append(root, totals.root(np.zeros(1), np.zeros(1)))
        pairs = np.flatnonzero(own.context == b)
        middle[own.word[pairs]] += own.n2[pairs] - d2 * own.t2[pairs]
        top = (1 + d3 * tables[outer]) * middle / (1 + c2[b])
        top[own.word[own.pair[here]]] += own.n[here] - d3 * own.t3[here]
        assert (top / (1 + own.c3[outer])).sum() == pytest.approx(1)


def test_packing_gives_back_the_columns():
    rng = np.random.default_rng(0)
    columns = [rng.integers(0, 2**63, 50, np.uint64), np.zeros(0, np.uint64), rng.integers(0, 300, 9), rng.random(5)]
    for x, y in zip(columns, grams.unpack(grams.pack(*columns)), strict=True):
        assert (x == y).all()
    dictionary = grams.Dictionary(np.arange(10, 20, dtype=np.uint64), np.arange(10), 10)
    counts, codes = dictionary.told(np.array([11, 5, 19, 11, 99], np.uint64))
    assert counts.tolist() == [1, 0, 9, 1, 0] and (codes == grams.ESCAPE).tolist() == [False, True, False, False, True]
    assert dictionary.words[codes[[0, 2]]].tolist() == [11, 19]


def test_contexts_over_several_groups_of_texts(monkeypatch):
    texts = corpus()
    monkeypatch.setattr(grams, "GROUP", 50)
    ranges, _, n = split_texts(texts, 2)
    assert sum(int(r.n.sum()) for r in ranges) == n


def test_scores(documents, no_documents, small):
    for docs in (documents, small("documents")):
        rows, scores = docs.collect(), defaultdict(list)
        for r in language_model.score_documents(docs).collect():
            scores[r.doc_id].append(r)
        tokens = lambda text: (text or "").encode().translate(LOWER).split() + [None]
        out = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 5 == 1
        counts = Counter(t for r in rows if not out(r.doc_id) for t in tokens(r.text))
        n, v = sum(counts.values()), len(counts)
        assert sum(map(len, scores.values())) == len(rows)
        for r in rows:
            t = tokens(r.text)
            base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)
            for s in scores[r.doc_id]:
                assert (s.held_out, s.n_tokens, s.n_known, s.train_tokens) == (out(r.doc_id), len(t), sum(counts[x] > 0 for x in t), n)
                assert s.base_score == pytest.approx(base, rel=1e-9) and s.score < 0
    by = {r.held_out: r for r in language_model.perplexity(language_model.score_documents(small("documents"))).collect()}
    assert by[True].perplexity < by[True].base_perplexity
    assert language_model.score_documents(no_documents).count() == 0


def test_null_ids_and_texts_have_their_own_scores(spark):
    docs = spark.createDataFrame([(5, None), (None, "5"), (6, "five words stand in here"), (None, None), (7, "five words stand in there")], "doc_id long, text string")
    by = {(r.doc_id, r.n_tokens): r for r in language_model.score_documents(docs).collect()}
    assert set(by) == {(5, 1), (None, 2), (6, 6), (None, 1), (7, 6)}
    assert by[5, 1].score == by[None, 1].score != by[None, 2].score


def test_ranges_and_shared_contexts_change_little(small, monkeypatch):
    docs = small("documents").limit(60)
    rows = lambda: {r.doc_id: (r.n_known, round(r.base_score, 8), r.score) for r in language_model.score_documents(docs).collect()}
    one, again = rows(), rows()
    assert one == again
    monkeypatch.setattr(language_model, "RANGE", 6000)
    monkeypatch.setattr(grams, "SPLIT", 300)
    many = rows()
    assert {i: x[:2] for i, x in one.items()} == {i: x[:2] for i, x in many.items()}
    assert sum(x[2] for x in many.values()) == pytest.approx(sum(x[2] for x in one.values()), rel=0.03)


def test_ranges_blobs_and_shared_contexts_change_nothing(small, monkeypatch):
    docs = small("documents").limit(60)
    rows = lambda: {r.doc_id: r for r in language_model.score_documents(docs).collect()}
    one = rows()
    for where, name, value in ((language_model, "RANGE", 6000), (language_model, "TOKENS", 3000), (grams, "SPLIT", 300), (grams, "GROUP", 50), (language_model, "WORDS", 100)):
        monkeypatch.setattr(where, name, value)
    many = rows()
    assert set(one) == set(many)
    for i, r in one.items():
        assert many[i][:-2] == r[:-2] and many[i][-2:] == pytest.approx(r[-2:], rel=1e-9)


def test_a_hot_trigram_context_is_one_restaurant(monkeypatch):
    texts = [f"same start word{i % 7}" for i in range(300)]
    words = [grams.hashed(t) for t in texts]
    every, counts = np.unique(np.concatenate(words), return_counts=True)
    dictionary = grams.Dictionary(np.append(every, np.uint64(2)), np.append(counts, len(texts)), int(counts.sum()))
    monkeypatch.setattr(grams, "GROUP", 20)
    blobs = [next(iter(grams.slices(words[k : k + 50], np.ones(50, bool), k, dictionary, 1)))[1] for k in range(0, 300, 50)]
    own = language_model.Range(0, blobs, dictionary)
    start, same = grams.START, grams.hashed("same")[0]
    assert set(own.outer_names.tolist()) == {int(x) for x in (start, same, grams.hashed("start")[0])}
    assert sorted(own.c3.tolist()) == [42] + [43] * 6 + [300] * 3
    assert len(own.n) == 1 + 1 + 7 + 7 and all(len(t) == 16 for t in own.types)

"""Scores of texts under a hierarchical Pitman-Yor trigram model, its seating sampled by Gibbs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grams import ESCAPE, Dictionary, hashed_texts, mixed, pack, part_of, slices, types_of, units, unpack
from .seating import drawn, gammas, share_discount
from .shared import cut, drop_table, fold, small_batches

FOLDS, HELD_OUT = 5, 1
#: Tokens of a range, that is of what a task samples at a time, and tokens that a task gathers before it hands them on.
RANGE, TOKENS = 1 << 20, 1 << 20
#: Words that get short codes.
WORDS = 1 << 19
#: Sweeps, each followed by an exchange with all restaurants, and samples whose predictive probabilities are averaged.
SWEEPS, SAMPLES = 3, 2
STRENGTH, SEED = 1.0, 11
#: Discounts of trigram contexts, bigram contexts and the root until they have been estimated.
DISCOUNTS = (0.8, 0.8, 0.8)


def count_words(texts: DataFrame) -> DataFrame:
    """word (its hash), n: how often each word stands in all texts; counted in each task before the shuffle."""

    def handed_on(words, counts):
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "n"])

    def count(batches):
        held, n = [], 0
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def merged():
            own, at = np.unique(np.concatenate([words, *held]), return_inverse=True)
            return own, np.bincount(at, weights=np.concatenate([counts, np.ones(n)]), minlength=len(own)).astype(np.int64)

        for batch in batches:
            for own in hashed_texts(batch.column(0).to_pylist()):
                held.append(own)
                n += len(own)
                if n >= TOKENS:
                    words, counts = merged()
                    held, n = [], 0
                    if len(words) >= TOKENS:
                        yield handed_on(words, counts)
                        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield handed_on(*merged())

    return texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def learn_dictionary(texts: DataFrame, most: int = WORDS) -> tuple[Dictionary, int]:
    """The dictionary of at most `most` words, all those from the least count that leaves so few, and the number of tokens."""
    counted = cut(count_words(texts), "words")
    size = F.floor(F.log2(F.col("n")) * 8)
    steps = counted.groupBy(size.alias("step")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).orderBy("step").collect()
    left, at = 0, None
    for row in reversed(steps):
        left += row["words"]
        if left > most:
            break
        at = row["step"]
    rows = counted.where(size >= at).toPandas() if at is not None else pd.DataFrame({"word": [], "n": []}, dtype=np.int64)
    tokens = sum(r["n"] for r in steps)
    drop_table(counted)
    words, counts = rows["word"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    # the start of a text is a context as often as there are texts; END, hash 1, has been counted as often
    ends = counts[words == 1]
    return Dictionary(np.append(words, np.uint64(2)), np.append(counts, ends if len(ends) else [0]).astype(np.int64)[: len(words) + 1], tokens), tokens


def spread(documents: DataFrame, dictionary: Dictionary, parts: int, whole: bool) -> DataFrame:
    """The texts' trigrams, packed by range; if `whole`, also the texts they stand in and a row for each text.

    documents: (doc_id, held_out, text). A text is named by (blob, idx); a blob is what a task gathered at a time, and
    its number follows from the task's. The row of a text has no types.
    """

    def packed(held, blob: int) -> Iterator[pa.RecordBatch]:
        n, lengths = len(held), [len(words) for words, _, _ in held]
        train = np.array([not out for _, _, out in held])
        rows = list(slices([words for words, _, _ in held], train, blob, dictionary, parts))
        if whole:
            own = [np.full(n, blob % parts, np.int32), np.full(n, -1, np.int32), np.full(n, blob), np.arange(n, dtype=np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, own), pa.array([i for _, i, _ in held], pa.string()), pa.array(~train), pa.array(lengths, pa.int64()), *[pa.nulls(n, pa.binary())] * 2], GRAMS)
        for k in range(0, len(rows), 64):
            r, types, texts = zip(*rows[k : k + 64], strict=True)
            m = len(r)
            blank = [pa.nulls(m, pa.int32()), pa.nulls(m, pa.string()), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.int64())]
            texts = pa.array(texts, pa.binary()) if whole else pa.nulls(m, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array([1] * m, pa.int32()), pa.array([blob] * m, pa.int64()), *blank, pa.array(types, pa.binary()), texts], GRAMS)

    def to_ranges(batches):
        blob, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            ids, outs, texts = (c.to_pylist() for c in batch.columns)
            for own, i, out in zip(hashed_texts(texts), ids, outs, strict=True):
                held.append((own, i, out))
                n += len(own)
                if n >= TOKENS:
                    yield from packed(held, blob)
                    blob, held, n = blob + 1, [], 0
        if held:
            yield from packed(held, blob)

    return documents.select("doc_id", "held_out", "text").mapInArrow(to_ranges, "range int, kind int, blob long, idx int, doc_id string, held_out boolean, n_tokens long, types binary, texts binary")


#: Columns of what is sent to the ranges. kind: -1 a text, 0 the news a range has got, 1 its trigrams.
GRAMS = ["range", "kind", "blob", "idx", "doc_id", "held_out", "n_tokens", "types", "texts"]


class Totals:
    """Sums over all restaurants that one range can't know: of the root, and of the contexts that several ranges share.

    rows: (name, a, b) with the names root (customers, tables), words (different ones, tokens), level 3, level 2 and
    level 0 (dishes with one and with two customers), and the hashes of shared contexts (customers, tables).
    """

    def __init__(self, rows) -> None:
        at = {r[0]: (int(r[1]), int(r[2])) for r in rows}
        self.customers, self.tables = at.pop("root", (0, 0))
        self.words, self.tokens = at.pop("words", (0, 0))
        self.discounts = tuple(share_discount(*at.pop(f"level {k}", (0, 0))) for k in (3, 2, 0))
        self.shared = {int(k): v for k, v in at.items()}

    def root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Probability of words at the root, whose parent is uniform over the words and one unknown one."""
        d = self.discounts[2]
        back = (STRENGTH + d * self.tables) / (self.words + 1)
        return (np.maximum(customers - d * tables, 0) + back) / (STRENGTH + self.customers)


def seeds(rng: np.random.Generator) -> list[int]:
    """Of a sweep: for trigram contexts, bigram contexts and the root."""
    return rng.integers(0, 2**62, 3).tolist()


def turn_rng(turn: int) -> np.random.Generator:
    return np.random.default_rng((SEED, turn))


def crowds(shape: np.ndarray, keys: np.ndarray, seed: int) -> np.ndarray:
    return gammas(shape, lambda k, rows: units(keys[rows], seed + k))


def seated(n: np.ndarray, log_rate: np.ndarray, others: np.ndarray | None, discount: float, keys: np.ndarray, seed: int) -> np.ndarray:
    """Tables of dishes; what is random follows from a dish's key, so it is the same wherever the dish is seated."""
    return drawn(n, log_rate, others, discount, units(keys, seed - 1), units(keys, seed - 2))


def pair_keys(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mixed(mixed(contexts) + words)


def seated_pairs(keys, crowd, n2, t2, root_n, root_t, totals: Totals, seed: int) -> np.ndarray:
    """Tables of the dishes of bigram contexts, given the root as it was before the sweep, without the dish's own tables."""
    _, d2, d0 = totals.discounts
    out, m = (n2 > 0).astype(np.int64), np.flatnonzero(n2 > 1)
    elsewhere = np.maximum(root_n[m] - t2[m], 0)
    weight = elsewhere - d0 * np.minimum(root_t[m], elsewhere + 1) + (STRENGTH + d0 * totals.tables) / (totals.words + 1)
    out[m] = seated(n2[m], np.log(d2 * crowd[m] / (STRENGTH + totals.customers)), weight, d2, keys[m], seed)
    return out


class Seats:
    """The restaurants of a range, their dishes and how many tables serve each.

    Trigram contexts (a, b) are children of bigram contexts (b), and these of the root. A context b that several
    ranges share is a restaurant that nobody owns here: its dishes' customers and tables come with the exchange. Where
    a context is seated changes nothing: all levels are drawn given their parents as of the last exchange.

    Types are trigrams: n (customers), pair, outer (their contexts). Pairs are (b, w): context, word, shared. single,
    alone3, alone2 and once say what else there is that has one customer and so one table: types of a pair, tables of
    an outer context, customers of a context, and how many types and pairs of all.
    """

    def start(self) -> None:
        self.many = np.flatnonzero(self.n > 1)
        self.crowded, self.crowd = np.unique(self.outer[self.many], return_inverse=True)
        self.t3 = (self.n > 0).astype(np.int64)
        self.n2 = self.customers()
        self.t2 = (self.n2 > 0).astype(np.int64)
        self.here = self.n2.copy()
        self.root_n, self.root_t, self.counts = (np.zeros(len(self.words), np.int64) for _ in range(3))

    @property
    def of_context(self) -> np.ndarray:
        return self.contexts[self.context]

    def outer_keys(self) -> np.ndarray:
        return mixed(mixed(self.contexts[self.outer_context[self.crowded]] ^ np.uint64(SEED)) + self.outer_names[self.crowded])

    def customers(self) -> np.ndarray:
        return np.bincount(self.pair, weights=self.t3, minlength=len(self.context)).astype(np.int64) + self.single

    # what goes to the root and comes back: words in the order of their owner, then of their code and hash

    def order(self, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        word_owner, shared = part_of(self.words, owners).astype(np.int64), np.flatnonzero(self.shared)
        pair_owner = word_owner[self.word[shared]]
        words = np.argsort(word_owner, kind="stable")
        pairs = np.lexsort((shared, pair_owner))
        return words, word_owner[words], shared[pairs], pair_owner[pairs]

    def up(self, owners: int, told: np.ndarray | None = None) -> list[tuple[int, bytes]]:
        """For each owner: words, their tables in restaurants here, their training tokens, what was known of the root;
        shared contexts' words, their customers here and what was known of their tables. told: pairs whose tables and customers count."""
        words, at, pairs, pair_at = self.order(owners)
        told = np.ones(len(self.context), bool) if told is None else told
        tables = np.bincount(self.word, weights=np.where(told & ~self.shared, self.t2, 0), minlength=len(self.words)).astype(np.int64)
        asked = np.bincount(self.word, weights=told & self.shared, minlength=len(self.words)) > 0
        root_n, root_t = (np.where(asked, x, 0) for x in (self.root_n, self.root_t))
        here, before = (np.where(told, x, 0) for x in (self.here, self.t2))
        out = []
        for o in np.unique(at).tolist():
            own, both = words[np.searchsorted(at, o) : np.searchsorted(at, o, "right")], pairs[np.searchsorted(pair_at, o) : np.searchsorted(pair_at, o, "right")]
            codes = self.codes[own]
            place = np.searchsorted(own, self.word[both])
            columns = [np.diff(codes, prepend=0), self.words[own[codes == ESCAPE]], tables[own], self.trained[own], root_n[own], root_t[own]]
            out.append((o, pack(*columns, self.context_codes[self.context[both]], place, here[both], before[both])))
        return out

    def down(self, blobs: dict[int, bytes], owners: int, totals: Totals) -> None:
        """Takes over the root's and the shared contexts' customers and tables."""
        words, _, pairs, _ = self.order(owners)
        self.totals = totals
        if not blobs:
            return
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*[unpack(blobs[o]) for o in sorted(blobs)], strict=True)]
        for mine, c in zip((self.root_n, self.root_t, self.counts), columns[:3], strict=True):
            mine[words] = c
        self.n2[pairs], self.t2[pairs] = columns[3], columns[4]

    def levels(self):
        """(tables of trigram contexts; customers and tables of bigram contexts), by context."""
        c2, t2 = (self.alone2 + np.bincount(self.context, weights=x, minlength=len(self.contexts)) for x in (self.n2, self.t2))
        for k in np.flatnonzero(np.isin(self.contexts, np.array(list(self.totals.shared), np.uint64))).tolist():
            c2[k], t2[k] = self.totals.shared[int(self.contexts[k])]
        return self.alone3 + np.bincount(self.outer, weights=self.t3, minlength=len(self.alone3)), c2, t2

    def reseat(self, seed: int) -> None:
        """Reseats all customers of every trigram context, given the parents' dishes without the dish's own tables.

        A restaurant's number of tables couples its dishes; given a gamma variable for each restaurant they are independent.
        """
        d3, d2, _ = self.totals.discounts
        tables, c2, t2 = self.levels()
        m, pair = self.many, self.pair[self.many]
        context, root = self.context[pair], self.totals.root(self.root_n, self.root_t)
        others = np.maximum(self.n2[pair] - self.t3[m], 0)
        weight = others - d2 * np.minimum(self.t2[pair], others + 1) + (STRENGTH + d2 * t2)[context] * root[self.word[pair]]
        outer = self.outer_keys()
        crowd = crowds(STRENGTH / d3 + tables[self.crowded], outer, seed)[self.crowd]
        keys = mixed(outer[self.crowd] + self.words[self.word[pair]])
        self.t3[m] = seated(self.n[m], np.log(d3 * crowd / (STRENGTH + c2[context])), weight, d3, keys, seed)

    def sweep(self, rng: np.random.Generator) -> None:
        """Reseats every trigram context and then every bigram context that lies here, given the root; numbers follow from one seed."""
        seed3, seed2, _ = seeds(rng)
        _, _, t2 = self.levels()
        self.reseat(seed3)
        before, self.here = self.here, self.customers()
        self.n2 = self.n2 + self.here - before
        own = np.flatnonzero(~self.shared)
        word = self.word[own]
        crowd = crowds(STRENGTH / self.totals.discounts[1] + t2, mixed(self.contexts), seed2)[self.context[own]]
        keys = pair_keys(self.of_context[own], self.words[word])
        self.t2[own] = seated_pairs(keys, crowd, self.n2[own], self.t2[own], self.root_n[word], self.root_t[word], self.totals, seed2)

    def sums(self) -> list[tuple[str, int, int]]:
        own = ~self.shared
        of = lambda x, k: int((x == k).sum())
        return [("level 3", of(self.n, 1) + self.once[0], of(self.n, 2)), ("level 2", of(self.n2[own], 1) + self.once[1], of(self.n2[own], 2))]


class Range(Seats):
    """All trigrams of a range, those of held-out texts included."""

    def __init__(self, number: int, blobs: list[bytes], dictionary: Dictionary) -> None:
        self.number = number
        a, b, w, self.n, names, self.types = types_of(blobs, dictionary)
        new_pair = np.r_[True, (b[1:] != b[:-1]) | (w[1:] != w[:-1])]
        self.pair = np.cumsum(new_pair) - 1
        outer, at = np.unique(b * len(names) + a, return_inverse=True)
        self.outer = at.astype(np.int64)
        b, w = b[new_pair], w[new_pair]
        new_b = np.r_[True, b[1:] != b[:-1]]
        self.context = np.cumsum(new_b) - 1
        used, word = np.unique(w, return_inverse=True)
        self.words, self.word = names[used], word.astype(np.int64)
        b = b[new_b]
        self.contexts, self.outer_names, self.outer_context = names[b], names[outer % len(names)], np.searchsorted(b, outer // len(names))
        self.codes, self.context_codes, self.outer_codes = (np.where(x < len(dictionary.words), x, ESCAPE) for x in (used, b, outer % len(names)))
        self.shared = np.isin(self.contexts, dictionary.split())[self.context]
        total = np.bincount(self.pair, weights=self.n, minlength=len(self.context)).astype(np.int64)
        self.trained = np.bincount(self.word, weights=total, minlength=len(self.words)).astype(np.int64)
        self.loose = (total > 1) | (self.shared & (total > 0))
        self.c3 = np.bincount(self.outer, weights=self.n)
        self.single, self.alone2, self.alone3, self.once = (np.zeros(k, np.int64) for k in (len(self.context), len(b), len(outer), 2))
        self.start()

    def guess(self, parts: int) -> None:
        """The root as this range's share of the contexts lets expect it, before any exchange."""
        local = np.bincount(self.word, weights=self.t2, minlength=len(self.words))
        self.root_n, self.root_t = np.where(local > 0, 1 + (local - 1) * parts, 0).astype(np.int64), (local > 0).astype(np.int64)
        ones = [int((self.n == k).sum()) for k in (1, 2)]
        self.totals = Totals([("root", self.root_n.sum(), self.root_t.sum() * parts), ("words", (self.root_t > 0).sum() * max(1, parts // 4), 0), ("level 3", *ones)])
        self.totals.discounts = DISCOUNTS

    def moving(self) -> list[np.ndarray]:
        """The columns of a Moving: whatever can have more than one customer."""
        pairs, one, many = np.flatnonzero(self.loose), self.n == 1, self.many
        contexts, context = np.unique(self.context[pairs], return_inverse=True)
        words, word = np.unique(self.word[pairs], return_inverse=True)
        still = ~self.loose & (self.n2 > 0)
        coded = lambda codes, names: [codes, names[codes == ESCAPE]]
        return [
            *coded(self.codes[words], self.words[words]), *coded(self.context_codes[contexts], self.contexts[contexts]), *coded(self.outer_codes[self.crowded], self.outer_names[self.crowded]),
            np.bincount(self.context, weights=still, minlength=len(self.contexts))[contexts].astype(np.int64), np.bincount(context, minlength=len(contexts)), word,
            np.bincount(self.pair, weights=one, minlength=len(self.context))[pairs].astype(np.int64), np.searchsorted(contexts, self.outer_context[self.crowded]),
            np.bincount(self.outer, weights=one, minlength=len(self.alone3))[self.crowded].astype(np.int64), (np.cumsum(self.loose) - 1)[self.pair[many]], self.crowd, self.n[many],
            np.array([one.sum(), (still & ~self.shared).sum()]), self.t3[many], self.t2[pairs],
        ]

    def restore(self, data: bytes) -> None:
        seated3, seated2 = unpack(data)[-2:]
        self.t3[self.many] = seated3.astype(np.int64)
        self.n2 = self.customers()
        self.t2 = (self.n2 > 0).astype(np.int64)
        self.t2[self.loose] = seated2.astype(np.int64)
        self.here = self.n2.copy()

    def predictive(self) -> np.ndarray:
        """The probability of each trigram's word."""
        d3, d2, _ = self.totals.discounts
        tables, c2, t2 = self.levels()
        root = self.totals.root(self.root_n, self.root_t)[self.word]
        middle = (np.maximum(self.n2 - d2 * self.t2, 0) + (STRENGTH + d2 * t2)[self.context] * root) / (STRENGTH + c2)[self.context]
        back = (STRENGTH + d3 * tables)[self.outer] * middle[self.pair]
        return (np.maximum(self.n - d3 * self.t3, 0) + back) / (STRENGTH + self.c3)[self.outer]


class Moving(Seats):
    """Of a range the trigrams that training texts hold more than once, and the pairs that do: all others keep one table."""

    def __init__(self, number: int, columns: list[np.ndarray], dictionary: Dictionary) -> None:
        self.number, self.columns = number, columns
        whole = lambda k: columns[k].astype(np.int64)
        self.codes, self.context_codes = whole(0), whole(2)
        self.words, self.contexts, self.outer_names = (dictionary.decoded(columns[k], columns[k + 1]) for k in (0, 2, 4))
        self.alone2, self.word, self.single, self.outer_context, self.alone3, self.pair, self.outer, self.n = (whole(k) for k in (6, 8, 9, 10, 11, 12, 13, 14))
        self.context, self.once = np.repeat(np.arange(len(self.contexts)), whole(7)), whole(15)
        self.shared = np.isin(self.contexts, dictionary.split())[self.context]
        self.trained = np.zeros(len(self.words), np.int64)
        self.start()
        self.t3, self.t2 = whole(16), whole(17)
        self.n2 = self.customers()
        self.here = self.n2.copy()

    def state(self) -> bytes:
        return pack(*self.columns[:-2], self.t3, self.t2)


OWNER = "range int, owner int, data binary, name string, a long, b long"
#: What data there is, in column a: restaurants that move, lists of all of a range's words, words an owner keeps.
MOVING, LISTED, KEPT = 0, 1, 2


def _rows(places: list[tuple[int | None, int, bytes, int]], sums: list[tuple[str, int, int]]) -> pa.RecordBatch:
    rows = [(r, o, data, None, kind, None) for r, o, data, kind in places] + [(None, None, None, *s) for s in sums]
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    types = (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["range", "owner", "data", "name", "a", "b"])


def shared_seats(owner: int, owners: int, blobs: list[bytes], dictionary: Dictionary, before: Totals | None, turn: int) -> tuple[list[bytes], list[tuple[str, int, int]]]:
    """What an owner of words answers to each range, and its part of the totals.

    It seats the customers of contexts that several ranges share as a range seats those of its own, given the root as it
    was; then it adds up all tables of its words and seats the root. Totals are those of the exchange before; at the
    first one everybody has one table.
    """
    parts = [[c if k == 1 else c.astype(np.int64) for k, c in enumerate(unpack(b))] for b in blobs]
    join = lambda k: np.concatenate([p[k] for p in parts])
    words, word = np.unique(np.concatenate([dictionary.decoded(np.cumsum(p[0]), p[1]) for p in parts]), return_inverse=True)
    add = lambda at, values, n: np.bincount(at, weights=values, minlength=n).astype(np.int64)

    def known(at, values, n):
        out = np.zeros(n, np.int64)
        np.maximum.at(out, at, values)
        return out

    tables, counts = add(word, join(2), len(words)), add(word, join(3), len(words))
    contexts, context = np.unique(dictionary.words[join(6)], return_inverse=True)
    begins = np.cumsum([0, *(len(p[0]) for p in parts)])
    dish = word[np.concatenate([at + p[7] for at, p in zip(begins, parts, strict=False)])]
    pairs, pair = np.unique(context.astype(np.int64) * max(1, len(words)) + dish, return_inverse=True)
    n2 = add(pair, join(8), len(pairs))
    place, of_word = pairs // max(1, len(words)), pairs % max(1, len(words))
    _, seed2, seed0 = seeds(turn_rng(turn))
    t2 = (n2 > 0).astype(np.int64)
    if before is not None and len(pairs):
        root = [known(word, join(k), len(words))[of_word] for k in (4, 5)]
        crowd = crowds(STRENGTH / before.discounts[1] + np.array([before.shared.get(c, (0, 0))[1] for c in contexts.tolist()]), mixed(contexts), seed2)
        t2 = seated_pairs(pair_keys(contexts[place], words[of_word]), crowd[place], n2, known(pair, join(9), len(pairs)), *root, before, seed2)
    root_n = tables + add(of_word, t2, len(words))
    root_t = (root_n > 0).astype(np.int64)
    if before is not None:
        d0, some = before.discounts[2], np.flatnonzero(root_n > 1)
        rate = d0 * crowds(np.array([STRENGTH / d0 + before.tables]), np.zeros(1, np.uint64), seed0) / (before.words + 1)
        root_t[some] = seated(root_n[some], np.full(len(some), np.log(rate[0])), None, d0, words[some], seed0)
    out, at, pair_at = [], 0, 0
    for p in parts:
        own, both = word[at : at + len(p[0])], pair[pair_at : pair_at + len(p[6])]
        at, pair_at = at + len(p[0]), pair_at + len(p[6])
        out.append(pack(root_n[own], root_t[own], counts[own], n2[both], t2[both]))
    once = sum(int(p[10][0]) for p in parts if len(p) > 10)
    sums = [("root", int(root_n.sum()) + once, int(root_t.sum()) + once), ("words", int((counts > 0).sum()) + once, int(counts.sum()) + once)]
    sums += [("level 0", int((root_n == 1).sum()) + once, int((root_n == 2).sum())), ("level 2", int((n2 == 1).sum()), int((n2 == 2).sum()))]
    seats = [add(place, x, len(contexts)).tolist() for x in (n2, t2)]
    return out, sums + [(str(c), x, y) for c, x, y in zip(contexts.tolist(), *seats, strict=True)]


def kept_words(lists: list[bytes], dictionary: Dictionary) -> bytes:
    """What an owner keeps of its ranges' lists while restaurants move, itself like one: words, their tables that don't
    move, their training tokens; and how many more words have one token and a table for it that doesn't move."""
    parts = [unpack(b) for b in lists]
    words, at = np.unique(np.concatenate([dictionary.decoded(np.cumsum(p[0].astype(np.int64)), p[1]) for p in parts]), return_inverse=True)
    tables, counts = (np.bincount(at, weights=np.concatenate([p[k] for p in parts]), minlength=len(words)).astype(np.int64) for k in (2, 3))
    once = (counts == 1) & (tables == 1)
    some = (counts > 0) & ~once
    words, tables, counts = words[some], tables[some], counts[some]
    codes = dictionary.told(words)[1]
    order = np.lexsort((words, codes))
    codes, none, blank = codes[order], np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    return pack(np.diff(codes, prepend=0), words[order][codes == ESCAPE], tables[order], counts[order], blank, blank, none, none, none, none, np.array([once.sum()]))


class Model:
    """The corpus's trigrams by range, and the states that sampling has led to."""

    def __init__(self, documents: DataFrame) -> None:
        self.documents = documents
        self.dictionary, tokens = learn_dictionary(documents.select("text"))
        self.parts = max(1, -(-tokens // RANGE))
        self.answers: DataFrame | None = None
        self.first: DataFrame | None = None
        self.totals: Totals | None = None
        self.turns = 0

    def _news(self) -> DataFrame:
        """What the ranges have got, states and answers; the owner's number, -1 for states, as blob."""
        news = self.answers.where(f"range IS NOT NULL AND a <> {KEPT}")
        return news.select("range", F.lit(0).alias("kind"), F.col("owner").cast("long").alias("blob"), F.col("data").alias("types"))

    def _sent(self, whole: bool) -> DataFrame:
        """The rows of each range one after the other, in one task: texts, news, trigrams."""
        sent = spread(self.documents, self.dictionary, self.parts, whole)
        if self.answers is not None:
            sent = sent.unionByName(self._news(), allowMissingColumns=True)
        return sent.repartition("range").sortWithinPartitions("range", "kind", "blob")

    def _opened(self):
        """A function that goes through such rows, with a Range for each range that has trigrams, and what it got in
        (blob, types, texts); and hands on the texts' rows."""
        dictionary, parts, totals = self.dictionary, self.parts, self.totals

        def made(number: int, news: dict[int, bytes], blobs: list[tuple]):
            own = Range(number, [b[1] for b in blobs], dictionary)
            if news:
                own.restore(news.pop(-1))
                own.down(news, parts, totals)
            return own, blobs

        def opened(batches):
            number, news, blobs = None, {}, []
            for batch in batches:
                kinds = batch.column(1).to_numpy()
                if (kinds < 0).any():
                    yield batch.filter(pa.array(kinds < 0)), None
                rows = batch.filter(pa.array(kinds >= 0)).select([0, 1, 2, 7, 8])
                for r, kind, blob, types, texts in zip(*[c.to_pylist() for c in rows.columns], strict=True):
                    if r != number:
                        if blobs:
                            done, blobs = blobs, []
                            yield made(number, news, done)
                            del done
                        number, news = r, {}
                    if kind == 0:
                        news[blob] = types
                    else:
                        blobs.append((blob, types, texts))
            if blobs:
                yield made(number, news, blobs)

        return opened

    def exchange(self, last: bool) -> None:
        """The first time reads the trigrams, everybody at one table; later sweeps in all ranges at the same time. Then the
        owners of words add up, seat the root and answer: the last time for all of a range's words, else for those that move."""
        opened, parts, dictionary, before, turn = self._opened(), self.parts, self.dictionary, self.totals, self.turns

        def begun(own):
            moving = Moving(own.number, own.moving(), dictionary)
            told = [(own.number, o, data, MOVING) for o, data in moving.up(parts)]
            lists = [(own.number, o, data, LISTED) for o, data in own.up(parts, ~own.loose)]
            return _rows([(own.number, -1, moving.state(), MOVING), *told, *lists], moving.sums())

        def begin(batches):
            for own, blobs in opened(batches):
                rows = begun(own)
                # a range goes before the next one is made
                own = blobs = None
                yield rows

        def move(batches):
            for (number,), (_, owners, data) in _runs(batches):
                news = dict(zip(owners, data, strict=True))
                own = Moving(number, unpack(news.pop(-1)), dictionary)
                own.down(news, parts, before)
                own.sweep(turn_rng(turn))
                yield _rows([(number, -1, own.state(), MOVING), *[(number, o, data, MOVING) for o, data in own.up(parts)]], own.sums())

        def answer(batches):
            for (owner,), (ranges, kinds, data) in _runs(batches):
                order = sorted(range(len(kinds)), key=lambda k: (kinds[k], ranges[k] or 0))
                out, sums = shared_seats(owner, parts, [data[k] for k in order], dictionary, before, turn)
                rows = [(ranges[k], owner, x, MOVING) for k, x in zip(order, out, strict=True) if kinds[k] == (LISTED if last else MOVING)]
                if not last:
                    lists = [data[k] for k in order if kinds[k] == LISTED]
                    rows += [(None, owner, kept_words(lists, dictionary), KEPT)] if lists else [(None, owner, data[k], KEPT) for k in order if kinds[k] == KEPT]
                yield _rows(rows, sums)

        if self.first is None:
            sent = self.first = cut(self._sent(False).mapInArrow(begin, OWNER), "sent")
            asked = sent.where("owner >= 0")
        else:
            rows = self._news().repartition("range").sortWithinPartitions("range")
            sent = cut(rows.mapInArrow(move, OWNER), "sent")
            asked = sent.where("owner >= 0").unionByName(self.first.where(f"owner >= 0 AND a = {LISTED}") if last else self.answers.where(f"owner >= 0 AND a = {KEPT}"))
        asked = asked.select("owner", "range", "a", "data").repartition("owner").sortWithinPartitions("owner")
        answered = cut(asked.mapInArrow(answer, OWNER).unionByName(sent.where("owner IS NULL OR owner < 0")), "answered")
        self.drop()
        if sent is not self.first:
            drop_table(sent)
        if last:
            drop_table(self.first)
        self.answers = answered
        # a row for each context that several ranges share, of which there are at most as many as words in the dictionary
        self.totals = Totals(answered.where("name IS NOT NULL").groupBy("name").agg(F.sum("a"), F.sum("b")).collect())
        self.turns += 1

    def drop(self) -> None:
        if self.answers is not None:
            drop_table(self.answers)

    def scores(self, samples: int) -> DataFrame:
        """doc_id, held_out, n_tokens, base (sum of log10(c + 0.5)), score, known (tokens with c > 0), c a word's count, of every text."""
        opened, turn = self._opened(), self.turns

        def told_of(own, blobs):
            mean = own.predictive() / samples
            for k in range(1, samples):
                own.reseat(seeds(turn_rng(turn + k))[0])
                mean += own.predictive() / samples
            of_word = own.word[own.pair]
            values = (np.log10(own.counts + 0.5)[of_word], np.log10(mean), (own.counts > 0)[of_word].astype(float))
            out = []
            for (_, _, texts), types in zip(blobs, own.types, strict=True):
                sizes, text, count = (c.astype(np.int64) for c in unpack(texts))
                idx, text = np.unique(text, return_inverse=True)
                each = np.repeat(types, sizes)
                base, total, known = (np.bincount(text, weights=count * v[each], minlength=len(idx)) for v in values)
                out.append(pack(idx, base, total, known.astype(np.int64)))
            blank = [pa.nulls(len(out), t) for t in (pa.int32(), pa.string(), pa.bool_(), pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([b[0] for b in blobs], pa.int64()), *blank, pa.array(out, pa.binary())], TOLD)

        def score(batches):
            for own, blobs in opened(batches):
                if blobs is None:
                    yield pa.RecordBatch.from_arrays([*own.columns[2:7], pa.nulls(own.num_rows, pa.binary())], TOLD)
                    continue
                rows = told_of(own, blobs)
                # a range goes before the next one is made
                own = blobs = None
                yield rows

        def add(batches):
            for _, (idx, ids, held_out, n_tokens, data) in _runs(batches):
                n = sum(k is not None for k in idx)
                order = sorted((k, i) for i, k in enumerate(idx) if k is not None)
                parts = [unpack(x) for x in data if x is not None]
                at = np.concatenate([p[0] for p in parts]).astype(np.int64)
                base, total, known = (np.bincount(at, weights=np.concatenate([p[k] for p in parts]), minlength=n) for k in (1, 2, 3))
                own = [[c[i] for _, i in order] for c in (ids, held_out, n_tokens)]
                columns = [pa.array(c, t) for c, t in zip(own, (pa.string(), pa.bool_(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(base), pa.array(total), pa.array(known.astype(np.int64))], ["doc_id", "held_out", "n_tokens", "base", "score", "known"])

        told = self._sent(True).mapInArrow(score, "blob long, idx int, doc_id string, held_out boolean, n_tokens long, data binary")
        return told.repartition("blob").sortWithinPartitions("blob").mapInArrow(add, "doc_id string, held_out boolean, n_tokens long, base double, score double, known long")


TOLD = ["blob", "idx", "doc_id", "held_out", "n_tokens", "data"]


def _runs(batches):
    """((key,), columns) of consecutive rows with the same first column."""
    key, held = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[0] != key:
                if held:
                    yield (key,), [list(c) for c in zip(*held, strict=True)]
                key, held = row[0], []
            held.append(row[1:])
    if held:
        yield (key,), [list(c) for c in zip(*held, strict=True)]


def score_documents(documents: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, sweeps: int = SWEEPS, samples: int = SAMPLES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    The model learns from all texts whose fold is not held out. A text's words are followed by one end token; a
    null or empty text is that token alone. base_score is the log10 probability with half a count added to each
    word; score that of the Pitman-Yor trigram model, its probabilities averaged over the samples. With nothing to
    learn from, both stand on the unknown word alone. Rows are scored one by one, whatever their ids, so repeated
    rows and rows with a null id or text each have their own score. Further columns are ignored.
    """
    id_type = documents.schema["doc_id"].dataType
    held = (fold(F.col("doc_id"), folds) == held_out).alias("held_out")
    model = Model(small_batches(documents).select(F.col("doc_id").cast("string").alias("doc_id"), held, F.col("text").cast("string").alias("text")))
    for k in range(sweeps + 1):
        model.exchange(k == sweeps)
    n, v = model.totals.tokens, model.totals.words
    base = F.col("base") - F.col("n_tokens") * F.log10(F.lit(n + 0.5 * (v + 1)))
    scored = cut(model.scores(samples), "scored").select(
        F.col("doc_id").cast(id_type).alias("doc_id"), "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score"
    )
    model.drop()
    return scored


def perplexity(scored: DataFrame) -> DataFrame:
    """held_out, perplexity, base_perplexity: ten to the mean negative log10 probability of a token."""
    of = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(of("score").alias("perplexity"), of("base_score").alias("base_perplexity"))

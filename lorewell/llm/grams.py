"""Trigrams of texts as packed columns: words by hash, frequent ones as short codes, sorted and compressed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard

from .shared import LOWER

#: The end and the start of a text, as words.
END, START = np.uint64(1), np.uint64(2)
#: Tokens from which a context is spread over several ranges, and trigrams of slices that are brought together at a time.
#: Both bound memory only; scores don't depend on them.
SPLIT, GROUP = 1 << 20, 1 << 22
ESCAPE = (1 << 24) - 1


_rng = np.random.default_rng(29)
#: A number for each byte, and the powers of an odd one by which the places in a word are told apart.
BYTES = _rng.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = np.cumprod(np.full(4096, 0xD1342543DE82EF95, np.uint64))


def hashed_texts(texts: list[str | None]) -> list[np.ndarray]:
    """Hashes of each text's words, of 48 bits, and its end. Of V words about V^2 / 2^48 pairs share one: of a billion 4,000."""
    if not len(texts):
        return []
    data = b"".join((t or "").encode("utf-8", "surrogatepass") + b" \xff " for t in texts).translate(LOWER)
    raw = np.frombuffer(data, np.uint8)
    at = np.flatnonzero((raw != 32) & ((raw < 9) | (raw > 13)))
    first = np.flatnonzero(np.r_[True, np.diff(at) > 1])
    size = np.diff(np.r_[first, len(at)])
    own = raw[at]
    place = np.arange(len(at)) - np.repeat(first, size)
    values = BYTES[own] * PLACES[place & 4095]
    if size.max() > 4096:
        values *= (2 * (place >> 12) + 1).astype(np.uint64)
    words = (mixed(np.add.reduceat(values, first) + size.astype(np.uint64)) >> np.uint64(16)) | np.uint64(4)
    ends = np.flatnonzero(own[first] == 255)
    words[ends] = END
    return np.split(words, ends[:-1] + 1)


def hashed(text: str | None) -> np.ndarray:
    return hashed_texts([text])[0]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def part_of(x: np.ndarray, parts: int) -> np.ndarray:
    """Which of equal hash ranges each number falls in."""
    return (mixed(x) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def planes(values: np.ndarray, width: int) -> bytes:
    """The bytes of numbers, all lowest ones first: most of the higher ones are zero and cost next to nothing."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def numbers(data: bytes, width: int) -> np.ndarray:
    n = len(data) // width if width else 0
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def _width(values: np.ndarray) -> int:
    top = int(values.max(initial=0))
    return max(1, (top.bit_length() + 7) // 8)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of unsigned numbers in one compressed value; float columns are kept as they are."""
    head, body = [len(columns)], []
    for c in columns:
        width = -c.dtype.itemsize if c.dtype.kind == "f" else _width(c)
        body.append(c.tobytes() if width < 0 else planes(c, width))
        head += [width, len(body[-1])]
    return zstandard.compress(np.array(head, "<i8").tobytes() + b"".join(body), 3)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(n, 2).tolist()
    at, out = 8 + 16 * n, []
    for width, size in head:
        part = raw[at : at + size]
        out.append(np.frombuffer(part, f"<f{-width}") if width < 0 else numbers(part, width))
        at += size
    return out


class Dictionary:
    """The most frequent words, of a bounded number, with their counts: they get short codes, and the most frequent
    contexts are spread over several ranges."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, tokens: int) -> None:
        order = np.lexsort((words, -counts))
        self.words = words[order].astype(np.uint64)
        self.by_hash = np.argsort(self.words, kind="stable")
        self.sorted = self.words[self.by_hash]
        self.counts = counts[order][self.by_hash].astype(np.int64)
        self.limit = max(SPLIT, tokens >> 17)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.sorted):
            return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.sorted, words), len(self.sorted) - 1)
        return at, self.sorted[at] == words

    def told(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, code) of each word; 0 and ESCAPE for those that aren't in the dictionary."""
        at, there = self.find(words)
        if not len(self.sorted):
            return np.zeros(len(words), np.int64), np.full(len(words), ESCAPE, np.int64)
        return np.where(there, self.counts[at], 0), np.where(there, self.by_hash[at], ESCAPE)

    def decoded(self, codes: np.ndarray, rare: np.ndarray) -> np.ndarray:
        """The words of codes; those without one are `rare`, in order."""
        out, plain = np.empty(len(codes), np.uint64), codes != ESCAPE
        out[plain], out[~plain] = self.words[codes[plain].astype(np.int64)], rare
        return out

    def split(self) -> np.ndarray:
        """The words whose contexts lie in several ranges, ascending."""
        return self.sorted[self.counts > self.limit]


def in_order(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of trigrams of numbers below n by b, then w, then a; and where in it a new one begins."""
    if n < 1 << 21:
        key = (b * n + w) * n + a
    else:
        key = np.unique(b * n + w, return_inverse=True)[1].astype(np.int64) * n + a
    order = np.argsort(key)
    key = key[order]
    return order, np.r_[True, key[1:] != key[:-1]][: len(key)]


def slices(texts: list[np.ndarray], train: np.ndarray, blob: int, dictionary: Dictionary, parts: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(range, its trigrams and their counts in training texts, the texts they stand in) of some texts' tokens.

    The trigram of a token is the word, the one before it and the one before that. Its range follows from the word
    before, b, so that a restaurant lies whole in one range; for a very frequent b from b and a, and its restaurant is
    shared. A trigram context (a, b) is never parted, however many tokens it has. Nothing depends on the blob's number.
    """
    lengths = np.array([len(t) for t in texts])
    names, w = np.unique(np.concatenate([*texts, [START]]), return_inverse=True)
    start, w = int(w[-1]), w[:-1].astype(np.int64)
    begins = np.r_[0, np.cumsum(lengths)[:-1]]
    b = np.r_[start, w[:-1]]
    b[begins] = start
    a = np.r_[start, b[:-1]]
    a[begins] = start
    text = np.repeat(np.arange(len(texts)), lengths)
    counts, codes = dictionary.told(names)
    by_code = np.lexsort((names, codes))
    rank = np.argsort(by_code, kind="stable")
    names, counts, codes = names[by_code], counts[by_code], codes[by_code]
    a, b, w = rank[a], rank[b], rank[w]
    order, new_type = in_order(a, b, w, len(names))
    text, number = text[order], np.cumsum(new_type) - 1
    new = np.flatnonzero(new_type | np.r_[True, text[1:] != text[:-1]])
    count, number, text = np.diff(np.r_[new, len(number)]), number[new], text[new]
    first = order[new_type]
    sizes = np.bincount(number, minlength=len(first))
    trained = np.bincount(number, weights=count * train[text], minlength=len(first)).astype(np.int64)
    a, b, w = a[first], b[first], w[first]
    pieces = np.maximum(1, -(-counts // dictionary.limit)).astype(np.uint64)
    spread = names[b].copy()
    wide = np.flatnonzero(pieces[b] > 1)
    spread[wide] += mixed(mixed(names[a[wide]]) % pieces[b[wide]])
    place = part_of(spread, parts).astype(np.int64)
    ends = np.r_[0, np.cumsum(sizes)]
    by_place = np.argsort(place.astype(np.uint16) if parts < 1 << 16 else place, kind="stable")
    bounds = np.flatnonzero(np.r_[True, np.diff(place[by_place]) != 0, True])

    def coded(ids):
        own = codes[ids]
        return own, names[ids[own == ESCAPE]]

    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        own = by_place[lo:hi]
        of = b[own]
        run = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        (of_b, rare_b), (of_w, rare_w) = coded(of[run]), coded(w[own])
        begin = of_w[run]
        of_w, of_b = np.diff(of_w, prepend=0), np.diff(of_b, prepend=0)
        of_w[run] = begin
        columns = [of_b, rare_b, np.diff(np.r_[run, len(own)]), *coded(a[own]), of_w, rare_w, trained[own]]
        some = np.repeat(ends[own] - np.r_[0, np.cumsum(sizes[own])[:-1]], sizes[own]) + np.arange(sizes[own].sum())
        yield int(place[own[0]]), pack(*columns), pack(sizes[own], text[some], count[some])


def types_of(blobs: list[bytes], dictionary: Dictionary):
    """(a, b, w, training counts, names, numbers of each slice's trigrams) of all slices' different trigrams, ordered by
    b, then w, then a: words are numbers, whose hashes are in names. Slices are brought together GROUP trigrams at a time."""
    parts = [unpack(data) for data in blobs]
    rare = np.unique(np.concatenate([p[k] for p in parts for k in (1, 4, 6)]))
    n, names = len(dictionary.words), np.concatenate([dictionary.words, rare])

    def numbered(codes, hashes):
        codes = codes.astype(np.int64)
        if len(hashes):
            codes[codes == ESCAPE] = n + np.searchsorted(rare, hashes)
        return codes

    def risen(steps, run):
        """Codes of words from the steps between them, which begin anew with each context."""
        total = np.cumsum(steps.astype(np.int64))
        starts = np.r_[0, np.cumsum(run)[:-1]].astype(np.int64)
        return total - np.repeat(np.r_[0, total][starts], run)

    def together(a, b, w, trained):
        order, new = in_order(a, b, w, len(names))
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        first = order[new]
        return a[first], b[first], w[first], np.bincount(of, weights=trained, minlength=len(first)).astype(np.int64), of

    ends = np.cumsum([len(p[7]) for p in parts])
    group = (ends - 1) // GROUP
    found, places = [], []
    for g in np.unique(group).tolist():
        own = [parts[k] for k in np.flatnonzero(group == g)]
        run = [p[2].astype(np.int64) for p in own]
        b = np.concatenate([np.repeat(numbered(np.cumsum(p[0]), p[1]), r) for p, r in zip(own, run, strict=True)])
        a = np.concatenate([numbered(p[3], p[4]) for p in own])
        w = np.concatenate([numbered(risen(p[5], r), p[6]) for p, r in zip(own, run, strict=True)])
        trained = np.concatenate([p[7] for p in own]).astype(np.int64)
        for k in np.flatnonzero(group == g):
            parts[k] = None
        del own
        *types, of = together(a, b, w, trained)
        found.append(types)
        places.append(of.astype(np.int32))
        del a, b, w, of
    types, of = found[0], places[0]
    if len(found) > 1:
        *types, merged = together(*(np.concatenate(c) for c in zip(*found, strict=True)))
        at = np.cumsum([0, *(len(f[0]) for f in found)])
        of = np.concatenate([merged[lo + p].astype(np.int32) for lo, p in zip(at, places, strict=False)])
    return *types, names, np.split(of, ends[:-1])


def units(keys: np.ndarray, seed: int) -> np.ndarray:
    """For each key a number between 0 and 1 that depends on it and the seed alone."""
    return ((mixed(mixed(keys ^ np.uint64(seed)) + np.uint64(seed)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53

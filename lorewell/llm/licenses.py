"""Licence notices in documents: exact phrases, and short notices with a bounded number of edits."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

#: Fixed phrases of the exact scan, with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Notices of the fuzzy scan: text, label, words that must stand unchanged because an edit could turn them into another
#: licence's. The exact phrases are among them.
NOTICES = (
    ("under the mit license", "mit", ("mit",)),
    ("released under the mit license", "mit", ("mit",)),
    ("licensed under the mit license", "mit", ("mit",)),
    ("permission is hereby granted free of charge", "mit", ()),
    ("apache license version 2", "apache-2", ("apache", "2")),
    ("licensed under the apache license version 2", "apache-2", ("apache", "2")),
    ("cc by nc", "cc-by-nc", ("nc",)),
    ("licensed under cc by nc 4 0", "cc-by-nc", ("nc",)),
    ("creative commons attribution noncommercial", "cc-by-nc", ()),
    ("licensed under the gnu general public license", "gpl", ("gnu",)),
    ("gnu lesser general public license", "lgpl", ("gnu",)),
    ("gnu affero general public license", "agpl", ("gnu",)),
    ("mozilla public license", "mpl", ()),
    ("redistribution and use in source and binary forms", "bsd", ()),
    ("all rights reserved", "all-rights-reserved", ()),
)
#: A notice may differ from the text by one edit for each so many of its characters; by one at least.
PER_EDIT = 15
#: Bytes that are no part of a word: all of ASCII but digits and letters. Letters become lower case.
TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


SPACES = regex.compile(" ")
#: Verified pieces of text that a worker remembers.
REMEMBERED = 1 << 16


def edits(notice: str) -> int:
    return max(1, len(notice) // PER_EDIT)


def seeds(notice: str) -> list[tuple[str, int]]:
    """(piece, offset) of edits + 1 pieces: with that many edits at most, one piece stands in the text unchanged."""
    n = edits(notice) + 1
    cuts = [round(i * len(notice) / n) for i in range(n + 1)]
    return [(notice[a:b], a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Scanner:
    """Exact phrases by their words, notices by exact seeds and then a bounded-error match of the whole words around each."""

    def __init__(self, phrases=PHRASES, notices=NOTICES) -> None:
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases]
        self.notices = [(n, label, edits(n), kept) for n, label, kept in notices]
        self.patterns = [regex.compile(rf"(?b)(?:{regex.escape(n)}){{e<={e}}}") for n, _, e, _ in self.notices]
        self.known: dict[tuple[int, str], int] = {}
        at: dict[str, list[tuple[int, int]]] = {}
        for k, (notice, *_) in enumerate(self.notices):
            for piece, offset in seeds(notice):
                at.setdefault(piece, []).append((k, offset))
        self.seeds = ahocorasick.Automaton()
        for piece, places in at.items():
            self.seeds.add_word(piece, (len(piece), places))
        self.seeds.make_automaton()

    def errors(self, k: int, piece: str) -> int:
        """Edits between a notice and some whole words; -1 if there are too many or a word that must stay is missing."""
        key = (k, piece)
        if (found := self.known.get(key)) is None:
            kept = self.notices[k][3]
            m = self.patterns[k].fullmatch(piece) if all(w in piece.split() for w in kept) else None
            found = sum(m.fuzzy_counts) if m else -1
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[key] = found
        return found

    def fuzzy(self, text: str, exact: dict[str, bytearray] | None = None) -> list[tuple[int, int, str, int, int]]:
        """(start, end, label, edits, length of the notice) of whole words that are a notice but for its edits.

        text: words joined by spaces. With e edits one of e + 1 pieces stands in the text unchanged, at most e
        characters from its place; every run of whole words that can be the notice from there is verified. Of matches
        of a label that overlap those with the fewest edits, then the first ones, stay. A seed inside of an exact
        phrase of its label is left out: `exact` marks these by label.
        """
        starts: list[int] = []
        found = set()
        for end, (length, places) in self.seeds.iter(text):
            for k, offset in places:
                notice, label, most, _ = self.notices[k]
                if exact and label in exact and exact[label][end] and exact[label][end + 1 - length]:
                    continue
                if not starts:
                    starts = [0, *(m.end() for m in SPACES.finditer(text))]
                    ends = [*(x - 1 for x in starts[1:]), len(text)]
                begin = end + 1 - length - offset
                for a in starts[bisect_left(starts, begin - most) : bisect_right(starts, begin + most)]:
                    for b in ends[bisect_left(ends, a + len(notice) - most) : bisect_right(ends, a + len(notice) + most)]:
                        if b > a and (e := self.errors(k, text[a:b])) >= 0:
                            found.add((e, a, -b, label, len(notice)))
        kept: list[tuple[int, int, str, int, int]] = []
        taken: dict[str, list[tuple[int, int]]] = {}
        for e, a, b, label, size in sorted(found):
            spans = taken.setdefault(label, [])
            at = bisect_left(spans, (a, -b))
            if (at == 0 or spans[at - 1][1] <= a) and (at == len(spans) or -b <= spans[at][0]):
                spans.insert(at, (a, -b))
                kept.append((a, -b, label, e, size))
        return sorted(kept)

    def scan(self, text: str | None) -> dict:
        data = (text or "").encode("utf-8", "surrogatepass")
        plain = data.translate(TABLE)
        words = plain.split()
        line = b" " + b" ".join(words) + b" "
        begins = np.r_[0, np.cumsum([len(w) + 1 for w in words])[:-1]] if words else np.zeros(0, np.int64)
        body = line[1:-1].decode("utf-8", "replace")
        chars = begins if len(body) == max(0, len(line) - 2) else None
        places, labels, exact = [], set(), {}
        for phrase, label in self.phrases:
            found, at = [], line.find(phrase)
            while at >= 0:
                found.append(at)
                at = line.find(phrase, at + 1)
            if found:
                labels.add(label)
                places.append(np.searchsorted(begins, found))
                if chars is None:
                    chars = np.r_[0, np.cumsum([len(w) + 1 for w in body.split(" ")])[:-1]]
                marks = exact.setdefault(label, bytearray(len(body)))
                for a in chars[places[-1]].tolist():
                    marks[a : a + len(phrase) - 2] = b"\1" * (len(phrase) - 2)
        where = np.concatenate(places) if places else np.zeros(0, np.int64)
        spans = self.fuzzy(body, exact) if words else []
        best = max([1.0] * bool(places) + [1 - e / n for *_, e, n in spans], default=0.0)
        return {
            "n_words": len(words), "n_base": len(where), "first_word": int(where.min()) if len(where) else None, "last_word": int(where.max()) if len(where) else None,
            "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | {s[2] for s in spans})), "score": best,
            "spans": self.located(data, plain, body, spans),
        }

    def located(self, data: bytes, plain: bytes, body: str, spans) -> list[dict]:
        """The spans by their characters in the document, and by words."""
        if not spans:
            return []
        inside = np.frombuffer(plain, np.uint8) != 32
        edges = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
        before = np.r_[0, np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)]
        own = [0, *(m.end() for m in SPACES.finditer(body))]
        out = []
        for a, b, label, e, _ in spans:
            first, last = bisect_left(own, a), bisect_left(own, b) - 1
            start, end = int(edges[2 * first]), int(edges[2 * last + 1])
            out.append({"start": int(before[start]), "end": int(before[end]), "first": first, "label": label, "edits": e, "text": data[start:end].decode("utf-8", "replace")})
        return out


@cache
def scanner(phrases=PHRASES, notices=NOTICES) -> Scanner:
    return Scanner(phrases, notices)


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start: int, end: int, first: int, label: string, edits: int, text: string>>"


def scan_licenses(documents: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """doc_id and what a scan of the whole text finds.

    n_words; n_base, first_word, last_word, base_labels: the places where a phrase's words stand one after the
    other; labels: those and the labels of the notices found with bounded edits; score: 1 for a phrase, else the
    share of the best notice's characters that needed no edit, else 0; spans: each notice found, its start and end
    by characters of the document, its first word, its edits and its text as it stands there. The work grows with the
    length of the text. A null or empty text has no words, no labels and score 0. Repeated rows stay; further columns are ignored.
    """

    @F.pandas_udf(SCHEMA)
    def scan(texts: pd.Series) -> pd.DataFrame:
        s = scanner(phrases, notices)
        return pd.DataFrame([s.scan(t) for t in texts], columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]).astype({"first_word": "Int64", "last_word": "Int64"})

    return small_batches(documents).select("doc_id", scan("text").alias("_scan")).select("doc_id", "_scan.*")

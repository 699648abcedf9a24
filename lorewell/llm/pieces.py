"""SentencePiece encoding and decoding: a Viterbi search driven by an Aho-Corasick automaton over the pieces."""

from __future__ import annotations

import hashlib
import struct
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

SPACE = "▁"
#: Piece types of a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Below the lowest score by so much: a character that no piece covers.
PENALTY = 10.0
LOWEST = float("-inf")
#: Stretches between spaces whose encoding a worker remembers, and the longest of them.
MEMORY, LONGEST = 1 << 18, 64
#: Texts encoded at a time.
ROWS = 256


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size


def read_pieces(model: bytes) -> tuple[list[tuple[str, float, int]], bool]:
    """(piece, score, type) by id, and whether a space goes before the text, from the bytes of a model file."""
    pieces, prefix = [], True
    for number, value in _fields(model):
        if number == 1:
            own = dict(_fields(value))
            pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
        elif number == 3:
            prefix = bool(dict(_fields(value)).get(3, 1))
    return pieces, prefix


class Encoder:
    """Best-scoring split of a text into pieces; what no piece covers becomes bytes."""

    def __init__(self, pieces: list[tuple[str, float, int]], prefix: bool = True) -> None:
        self.pieces, self.prefix = pieces, prefix
        text = [(p, s, i) for i, (p, s, kind) in enumerate(pieces) if kind in (NORMAL, USER, UNUSED) and p]
        self.floor = min((s for _, s, _ in text), default=0.0) - PENALTY
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.automaton = ahocorasick.Automaton()
        for p, s, i in text:
            self.automaton.add_word(p, (len(p), s, i))
        self.automaton.make_automaton()
        self.alone = frozenset(p for p, _, _ in text if len(p) == 1)
        #: If spaces stand in pieces only at the start, or alone, no piece crosses from a word to the next space.
        self.separable = all(SPACE not in p.lstrip(SPACE) for p, _, _ in text)
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def normal(self, text: str) -> str:
        text = text.replace(" ", SPACE)
        return SPACE + text if self.prefix and text else text

    def search(self, text: str) -> tuple[int, ...]:
        """One pass from left to right.

        The automaton reports, at each character, the pieces that end there: the longest, then along its output
        links the shorter ones. Each relaxes the best score of the place behind it from the place where it starts.
        """
        n = len(text)
        best, start, last = [0.0] + [LOWEST] * n, [0] * (n + 1), [-1] * (n + 1)
        if self.alone.issuperset(text):
            for end, (length, score, piece) in self.automaton.iter(text):
                total = best[end + 1 - length] + score
                if total > best[end + 1]:
                    best[end + 1], start[end + 1], last[end + 1] = total, end + 1 - length, piece
        else:
            matches = self.automaton.iter(text)
            end, found = next(matches, (n, None))
            for at in range(n):
                to = at + 1
                while end == at:
                    length, score, piece = found
                    if (total := best[to - length] + score) > best[to]:
                        best[to], start[to], last[to] = total, to - length, piece
                    end, found = next(matches, (n, None))
                if text[at] not in self.alone and (total := best[at] + self.floor) > best[to]:
                    best[to], start[to], last[to] = total, at, -1
        out, to = [], n
        while to:
            if last[to] >= 0:
                out.append(last[to])
            else:
                out += [self.bytes.get(b, self.unknown) for b in reversed(text[start[to] : to].encode("utf-8", "surrogatepass"))] if self.bytes else [self.unknown]
            to = start[to]
        return tuple(reversed(out))

    def remember(self, stretch: str) -> tuple[int, ...]:
        """The stretch's pieces, searched for once as long as it is remembered: what was asked for since the memory
        was last full stays, the rest is forgotten the next time."""
        found = self.known.get(stretch)
        if found is None:
            found = self.older.get(stretch) or self.search(stretch)
            if len(stretch) <= LONGEST:
                if len(self.known) >= MEMORY:
                    self.older, self.known = self.known, {}
                self.known[stretch] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        text = self.normal(text or "")
        if not self.separable:
            return list(self.search(text))
        # a stretch runs from a run of spaces to the end of the word behind it
        out: list[int] = []
        gap = ""
        head, *words = text.split(SPACE)
        if head:
            out += self.remember(head)
        for word in words:
            gap += SPACE
            if word:
                out += self.remember(gap + word)
                gap = ""
        if gap:
            out += self.remember(gap)
        return out

    def decode(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        for i in ids:
            piece, _, kind = self.pieces[i]
            if kind == BYTE:
                raw.append(int(piece[3:5], 16))
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if kind != CONTROL:
                out.append(" ⁇ " if kind == UNKNOWN else piece)
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


_encoders: dict[bytes, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    """The encoder of a model file's bytes, built once in each worker."""
    key = hashlib.sha256(model).digest()
    if key not in _encoders:
        _encoders[key] = Encoder(*read_pieces(model))
    return _encoders[key]


def model_bytes(path: str) -> bytes:
    """Read on the driver; tasks get the bytes, which are as many as a vocabulary has, whatever the corpus."""
    with open(path, "rb") as f:
        return f.read()


def _column(lists: list[list[int]]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(list(map(len, lists)))]).astype(np.int32)
    flat = np.fromiter(chain.from_iterable(lists), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_documents(documents: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>), exact (decoding gives the text back) of every document.

    The split of greatest summed piece score, by the scores of the model file; ties go to the longer last piece.
    Decoding restores the text, but for a text that itself holds U+2581, which comes back as spaces. A null or
    empty text has no ids and decodes to empty text. Texts of any length are read whole. Repeated rows stay;
    further columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model_bytes(model_path))

    def encode(batches):
        e = encoder(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = list(map(e.encode, texts))
                exact = [e.decode(i) == t for i, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, ids)), pa.int64()), _column(ids), pa.array(exact)], ["doc_id", "n_tokens", "ids", "exact"])

    rows = small_batches(documents).select("doc_id", "text")
    return rows.mapInArrow(encode, f"doc_id {rows.dtypes[0][1]}, n_tokens long, ids array<int>, exact boolean")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text from the columns doc_id and ids; null ids give empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model_bytes(model_path))

    @F.pandas_udf("string")
    def decode(lists: pd.Series) -> pd.Series:
        e = encoder(shared.value)
        return pd.Series(["" if i is None else e.decode(i.tolist()) for i in lists], dtype=object)

    return encoded.select("doc_id", decode("ids").alias("text"))

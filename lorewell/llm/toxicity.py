"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton over folded text."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop_table, fold, small_batches

#: Most labelled rows of either class that weights and scale are fitted to.
SAMPLE = 5_000
THRESHOLD, FOLDS, HELD_OUT = 0.5, 5, 0
#: Fixed words that need no labels; a weight is a log ratio.
WORDS = ("idiot", "idiots", "moron", "morons", "scum", "stupid", "loser", "losers", "pathetic", "worthless", "disgusting", "trash", "clown")
WEIGHT = 5.0
#: Fixed phrases in which those words are harmless.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "class clown", "clown fish", "pond scum")
#: Fixed lookalikes of Latin letters, by script: Cyrillic, Greek, Armenian, Cherokee, small capitals, letters with strokes.
LOOKALIKES = dict(
    zip(
        "авеёкмнорстухѕіїјһԁԛԝ" + "αβεικνορτυχ" + "օոսհցզ" + "ᎪᏴᏟᎠᎬᏀᎻᎥᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ" + "ᴀʙᴄᴅᴇɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢ" + "ıłøđħŧƒɡɑ",
        "abeekmhopctyxsiijhdqw" + "abeikvoptux" + "onuhgq" + "abcdeghijklmprstvwz" + "abcdeghijklmnoprstuvwyz" + "ilodhtfga",
        strict=True,
    )
)
#: Fixed substitutions of letters inside words. Letters that the same sign can stand for are one letter when folded: l is i.
SIGNS = str.maketrans("013456789@$", "oieasgtbgas")
BARS = str.maketrans("!|", "ii")
SAME = {"l": "i"}
#: Prefixes of words that may become terms, and how often a term must stand in toxic training texts.
PREFIXES, LEAST, RATIO = range(4, 9), 5, 8.0
#: Rounds of learning, and the least share of a round's most frequent term.
ROUNDS, SHARE = 4, 0.2


def _folds() -> dict[int, str | None]:
    """What each code point becomes: a letter that it looks like or is made of, a space, or nothing."""
    table: dict[int, str | None] = {c: " " for c in range(0x80) if not chr(c).isalnum() and chr(c) not in "@$!|"}
    near = [*range(0x80, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), *range(0xFF00, 0xFF60)]
    for c in near:
        base = unicodedata.normalize("NFKD", chr(c))[0].lower()
        base = LOOKALIKES.get(base, base)
        table[c] = None if c == 0xAD or unicodedata.category(chr(c)) == "Cf" else SAME.get(base, base) if base.isalnum() else " "
    for c in (*range(0x250, 0x370), *range(0x530, 0x1E00), *range(0x2070, 0x3400), *range(0xA640, 0xAC00), *range(0xF900, 0xFF00), *range(0x10000, 0x20000)):
        own = LOOKALIKES.get(chr(c)) or LOOKALIKES.get(chr(c).lower()) or unicodedata.normalize("NFKD", chr(c)).strip("()")[:1].lower()
        own = LOOKALIKES.get(own, own)
        if "a" <= own <= "z" or "0" <= own <= "9":
            table[c] = SAME.get(own, own)
    table |= {ord(x): SAME.get(y, y) for x, y in LOOKALIKES.items()}
    table |= {c: SAME.get(chr(c + 32), chr(c + 32)) for c in range(65, 91)} | {ord("l"): "i"} | {c: None for c in range(0x300, 0x370)} | {0xFEFF: None}
    return table


FOLDS_TABLE = str.maketrans(_folds())
MIXED = re.compile(r"(?<=[a-z])[0-9@$]+|[0-9@$]+(?=[a-z])")
#: A bar or an exclamation mark is a letter where a word goes on after it, never at a word's end.
BARRED = re.compile(r"[!|]+(?=[a-z0-9@$])")
LONE = str.maketrans("!|", "  ")


def folded(text: str | None) -> str:
    """Lower-case words between single spaces, in which lookalikes, accents and, inside of words, digits and signs have
    become letters, and letters that one sign can stand for are one."""
    line = (text or "").translate(FOLDS_TABLE)
    if "!" in line or "|" in line:
        line = BARRED.sub(lambda m: m[0].translate(BARS), line).translate(LONE)
    line = MIXED.sub(lambda m: m[0].translate(SIGNS), line)
    return " ".join(line.split())


class Lexicon:
    """Terms with weights, exception phrases, and the scale that makes a matched weight a score.

    A term that ends in a space is a whole word or phrase, another one the beginning of a word.
    """

    def __init__(self, terms: dict[str, float] | None = None, exceptions=EXCEPTIONS) -> None:
        self.terms = {f" {folded(w)} ": WEIGHT for w in WORDS} if terms is None else terms
        self.exceptions = exceptions
        self.scale = np.array([-4.0, 3.0])
        self.automaton = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            self.automaton.add_word(term, (len(term), weight))
        for phrase in exceptions:
            self.automaton.add_word(f" {folded(phrase)} ", (len(folded(phrase)) + 2, None))
        self.automaton.make_automaton()

    def matched(self, text: str | None) -> tuple[float, int]:
        """(summed weight of the words hit, outside of exceptions; number of words); a word counts once, by its heaviest term."""
        line = folded(text)
        if not line:
            return 0.0, 0
        hits, harmless = {}, []
        for end, (length, weight) in self.automaton.iter(f" {line} "):
            start = end + 1 - length
            if weight is None:
                harmless.append((start, end))
            elif weight > hits.get(start, 0.0):
                hits[start] = weight
        for a, b in harmless:
            for start in [s for s in range(a, b) if s in hits]:
                del hits[start]
        return sum(hits.values()), line.count(" ") + 1

    def inputs(self, texts) -> np.ndarray:
        pairs = np.array([self.matched(t) for t in texts], np.float64).reshape(-1, 2)
        return np.column_stack([np.ones(len(pairs)), np.log1p(100 * pairs[:, 0] / (pairs[:, 1] + 20))])

    def score(self, texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(texts) @ self.scale, -30, 30)))


def terms_of(text: str | None) -> set[str]:
    words = set(folded(text).split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in PREFIXES if len(w) >= k}


def choose(bad: dict[str, int], good: dict[str, int], n_bad: int, n_good: int) -> dict[str, float]:
    """Terms that RATIO times the share of toxic texts hold, sure to two standard errors, with the log of the smoothed ratio.

    A word's beginning is taken only if it stands in clearly more toxic texts than any longer form of it, and then
    the longer forms are not.
    """
    strong = {}
    for x, n in bad.items():
        m = good.get(x, 0)
        weight = float(np.log((n + 0.5) / (n_bad + 1) * (n_good + 1) / (m + 0.5)))
        if weight - 2 * (1 / (n + 0.5) + 1 / (m + 0.5)) ** 0.5 >= np.log(RATIO):
            strong[x] = weight
    taken: dict[str, float] = {}
    longer: dict[str, int] = {}
    strong = {x: w for x, w in strong.items() if bad[x] >= SHARE * max(bad[y] for y in strong)} if strong else strong
    for x in sorted(strong, key=lambda x: (-bad[x], -len(x), x)):
        shorter = [x[:k] for k in range(2, len(x))]
        if 1.2 * longer.get(x, 0) < bad[x] and not any(y in taken for y in shorter):
            taken[x] = strong[x]
            longer |= {y: max(longer.get(y, 0), bad[x]) for y in shorter}
    return taken


def calibrated(lexicon: Lexicon, x: np.ndarray, toxic: np.ndarray) -> Lexicon:
    """The scale by logistic regression, both classes weighing the same; unchanged without texts of both."""
    if toxic.all() or not toxic.any():
        return lexicon
    weights = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
    at = lexicon.scale.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1]), x.T @ (weights * (p - toxic)) + 1e-3 * at)
        at = at - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    lexicon.scale = at
    return lexicon


def _counted(texts: DataFrame, among: set[str] | None = None) -> DataFrame:
    """term, n: in how many texts each term stands; counted in each task before the shuffle."""

    def count(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(terms_of(text) if among is None else terms_of(text) & among)
        terms = list(counts)
        for k in range(0, len(terms), 1 << 16):
            part = terms[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([counts[t] for t in part], pa.int64())], ["term", "n"])

    return texts.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS, held_out: int = HELD_OUT) -> Lexicon:
    """The lexicon of the fixed words and of the terms learned from labelled rows whose fold is not held out.

    Of either class the `sample` documents with the smallest hash of the doc_id are used; one with contradicting
    labels teaches nothing, and copies of a text count once. Each round counts terms in the toxic texts that no term
    has hit so far, so words that merely stand beside toxic ones are not learned. Terms are counted by Spark; the
    driver gets those that at least half a percent of these texts hold, and two numbers for each text of the sample. Without texts of both classes the fixed words
    and scale remain.
    """
    small_batches(documents)
    learnt = labels.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    marked = learnt.groupBy("doc_id").agg(F.min("toxic").alias("_toxic"), F.max("toxic").alias("_most")).where("_toxic = _most")
    known = marked.join(documents.select("doc_id").distinct(), "doc_id").select("doc_id", "_toxic")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("_toxic = 1").orderBy(*order).limit(sample).unionByName(known.where("_toxic = 0").orderBy(*order).limit(sample))
    texts = cut(documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select((F.col("_toxic") == 1).alias("toxic"), "text").dropDuplicates(["text"]), "labelled")
    n_bad, n_good = texts.where("toxic").count(), texts.where("NOT toxic").count()
    lexicon = Lexicon()
    if not n_bad or not n_good:
        return lexicon
    for _ in range(ROUNDS):
        rest = texts.where("toxic").where(~hit(lexicon)("text"))
        n_rest = rest.count()
        if n_rest < max(LEAST, 0.01 * n_bad):
            break
        bad = {r["term"]: r["n"] for r in _counted(rest).where(F.col("n") >= max(LEAST, 0.005 * n_rest)).collect()}
        good = {r["term"]: r["n"] for r in _counted(texts.where("NOT toxic"), set(bad)).collect()}
        if not (terms := choose(bad, good, n_rest, n_good)):
            break
        lexicon = Lexicon(lexicon.terms | terms)

    @F.pandas_udf("array<double>")
    def measure(batch: pd.Series) -> pd.Series:
        return pd.Series(list(lexicon.inputs(batch)))

    rows = texts.select("toxic", measure("text").alias("x")).toPandas()
    drop_table(texts)
    return calibrated(lexicon, np.array(rows["x"].tolist()), rows["toxic"].to_numpy(bool))


def hit(lexicon: Lexicon):
    terms, exceptions = lexicon.terms, lexicon.exceptions

    @F.pandas_udf("boolean")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Lexicon(terms, exceptions)
        for texts in batches:
            yield pd.Series([own.matched(t)[0] > 0 for t in texts], dtype=bool)

    return hits


def scorer(lexicon: Lexicon):
    terms, scale, exceptions = lexicon.terms, lexicon.scale, lexicon.exceptions

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Lexicon(terms, exceptions)
        own.scale = scale
        for texts in batches:
            yield pd.Series(own.score(texts))

    return score


def score_documents(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    The score depends on the text alone. A null text counts as empty; a text without hits gets the scale's lowest
    score. Repeated rows stay; further columns are ignored.
    """
    folds, held = options.get("folds", FOLDS), options.get("held_out", HELD_OUT)
    score = scorer(train(documents, labels, **options))
    scored = small_batches(documents).select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_civil(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    score = scorer(train(documents, labels, **options))
    return small_batches(documents).where(score("text") < threshold)

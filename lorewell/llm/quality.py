"""Quality classifier learned from trusted positives and unlabelled text (non-negative PU risk)."""

from __future__ import annotations

from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop_table, fold, small_batches

#: Most trusted positives, which are labelled rows, that the model is fitted to; unlabelled rows all count.
SAMPLE = 20_000
THRESHOLD, FOLDS, HELD_OUT, RIDGE = 0.7, 4, 2, 3e-3
#: Newton steps of a fit.
STEPS = 12
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#$%&*+<=>@[\\]^_`{|}~!")] = True
DIGITS = np.zeros(256, bool)
DIGITS[48:58] = True
NAMES = ("upper", "symbols", "symbol_ends", "bars", "stutter", "digits", "repeats", "same_lines")


def features(text: str | None) -> np.ndarray:
    """Shares of shapes in a whole text, none of its length or language; the constants added to counts keep a few words from
    weighing like many."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lines = [x for x in data.split(b"\n") if x.strip()]
    symbols = int(counts[SYMBOLS].sum())
    return np.array([
        sum(map(bytes.isupper, words)) / (n + 10),
        min(3.0, symbols / (n + 10)),
        sum(SYMBOLS[[w[-1] for w in words]]) / (n + 10) if words else 0.0,
        min(1.0, counts[124] / (n + 10)),
        sum(map(eq, words, words[1:])) / (n + 10),
        counts[DIGITS].sum() / (len(data) + 50),
        (n - len(set(words))) / (n + 30),
        (len(lines) - len(set(lines))) / (len(lines) + 5),
    ])


def matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts]).reshape(-1, len(NAMES))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


class Model:
    """A linear score of standardised features, squashed to 0 to 1."""

    def __init__(self, width: int = len(NAMES)) -> None:
        self.mean, self.scale, self.weights, self.bias = np.zeros(width), np.ones(width), np.zeros(width), 0.0
        self.fitted = False

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


class Rows:
    """A table of packed feature rows, which stays with Spark: sums over all of them are what the driver gets."""

    def __init__(self, packed: DataFrame, width: int) -> None:
        self.packed, self.width = packed, width
        count, *sums = self.sums(lambda x: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 1 + 2 * width)
        self.n = int(count)
        self.first, self.second = np.array(sums[:width]), np.array(sums[width:])

    def sums(self, of, size: int) -> np.ndarray:
        """The sum of of(rows), an array of `size` numbers, over all rows: added up in each task first."""
        width = self.width

        def add(batches):
            total = np.zeros(size)
            for batch in batches:
                total += of(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float32).reshape(-1, width).astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(total)], ["x"])

        rows = self.packed.mapInArrow(add, "x double").withColumn("at", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33)))
        total = np.zeros(size)
        for r in rows.groupBy("at").agg(F.sum("x").alias("x")).collect():
            total[r["at"]] = r["x"]
        return total


class Array:
    """The same sums over rows that are at hand."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows, self.n = rows, len(rows)
        self.first, self.second = rows.sum(0), (rows * rows).sum(0)

    def sums(self, of, size: int) -> np.ndarray:
        return of(self.rows)


def _moments(model: Model, at: np.ndarray):
    """A function of rows that gives the summed logistic loss as negatives, its gradient and its second derivatives."""
    mean, scale = model.mean, model.scale

    def of(x: np.ndarray) -> np.ndarray:
        z = np.hstack([np.clip((x - mean) / scale, -6, 6), np.ones((len(x), 1))])
        m = z @ at
        p = sigmoid(m)
        return np.concatenate([[np.logaddexp(0, m).sum()], z.T @ p, (z.T @ (z * (p * (1 - p))[:, None])).ravel()])

    return of


def _minimise(model: Model, positive: np.ndarray, unlabelled, prior: float | None) -> None:
    """Damped Newton steps on weights and bias, of the balanced logistic loss (no prior) or of the non-negative risk.

    The risk as it stands is convex: with the logistic loss the positives' part is linear. Where what is left of
    the unlabelled rows' loss falls below zero, a step leads it up again.
    """
    p, k = np.hstack([model.standard(positive), np.ones((len(positive), 1))]), positive.shape[1] + 1
    at = np.append(model.weights, model.bias)
    ridge = RIDGE * np.append(np.ones(k - 1), 1e-6)
    for _ in range(STEPS):
        total = unlabelled.sums(_moments(model, at), 1 + k + k * k) / unlabelled.n
        loss, gradient, bend = total[0], total[1 : 1 + k], total[1 + k :].reshape(k, k)
        m = p @ at
        q = sigmoid(m)
        if prior is None:
            gradient, bend = gradient / 2 - (p * (1 - q)[:, None]).mean(0) / 2, bend / 2 + p.T @ (p * (q * (1 - q))[:, None]) / len(p) / 2
        elif loss - prior * np.logaddexp(0, m).mean() < 0:
            gradient, bend = -(gradient - prior * (p * q[:, None]).mean(0)), bend + np.eye(k)
        else:
            gradient = gradient - prior * p.mean(0)
        step = np.linalg.solve(bend + np.diag(ridge + 1e-6), gradient + ridge * at)
        at = at - step * min(1.0, 3 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-5:
            break
    model.weights, model.bias = at[:-1], float(at[-1])


def class_prior(positive: np.ndarray, shares) -> float:
    """The share of positives among the unlabelled, from scores that tell the two samples apart.

    Positives are the same share of any region in both samples, so the ratio of the regions' shares bounds the
    prior from above; the estimate is the smallest ratio over upper sets that hold at least half of the positives.
    shares(cuts): the unlabelled rows' shares at each cut and above.
    """
    cuts = np.quantile(positive, np.linspace(0.0, 0.5, 51))
    have = np.array([(positive >= c).mean() for c in cuts])
    return float(np.clip((shares(cuts) / have).min(), 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled, prior: float | None = None) -> Model:
    """Minimises the non-negative risk: prior x loss of the positives, plus what is left of the unlabelled text's
    loss as negatives after the positives' share is taken off, which counts as zero when it falls below that.
    unlabelled: Rows, all of which count, or an array. Without rows of either kind every score is 0.5.
    """
    unlabelled = Array(unlabelled) if isinstance(unlabelled, np.ndarray) else unlabelled
    model = Model(positive.shape[1])
    if not len(positive) or not unlabelled.n:
        return model
    n = len(positive) + unlabelled.n
    model.mean = (positive.sum(0) + unlabelled.first) / n
    spread = np.sqrt(np.maximum((positive**2).sum(0) + unlabelled.second - n * model.mean**2, 0) / n)
    model.scale = np.where(spread > 1e-9, spread, 1)
    if prior is None:
        _minimise(model, positive, unlabelled, None)
        mean, scale, weights, bias = model.mean, model.scale, model.weights, model.bias
        score = lambda x: np.clip((x - mean) / scale, -6, 6) @ weights + bias
        shares = lambda cuts: unlabelled.sums(lambda x: (score(x)[:, None] >= cuts[None, :]).sum(0), len(cuts)) / unlabelled.n
        prior = class_prior(score(positive), shares)
    _minimise(model, positive, unlabelled, prior)
    model.fitted = True
    return model


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS, held_out: int = HELD_OUT) -> Model:
    """The model of the rows whose fold is not held out.

    Positives: documents that all their labels call 1; of these the `sample` with the smallest hash of the doc_id.
    Unlabelled: all documents without a label; if every document has one, all of these rows, whatever their labels,
    stand for the unlabelled, and the labels of negatives are not used. Features are written once; each step of the fit sums
    over them where they are.
    """
    learn = small_batches(documents).select("doc_id", "text").where(fold(F.col("doc_id"), folds) != held_out)
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    width = len(NAMES)

    @F.pandas_udf("binary")
    def measure(texts: pd.Series) -> pd.Series:
        return pd.Series([x.tobytes() for x in matrix(texts).astype(np.float32)], dtype=object)

    kind = F.when(F.col("_quality") == 1, 1).when(F.col("_quality").isNull(), 0).otherwise(2).alias("kind")
    measured = learn.select("doc_id", measure("text").alias("data"))
    table = cut(measured.join(marked, "doc_id", "left").select(kind, F.col("doc_id").cast("string").alias("id"), "data"), "features")
    good = table.where("kind = 1").orderBy(F.xxhash64("id"), "id", "data").limit(sample).select("data").toPandas()["data"]
    positive = np.array([np.frombuffer(x, np.float32) for x in good], np.float64).reshape(-1, width)
    unlabelled = Rows(table.where("kind = 0").select("data"), width)
    if not unlabelled.n:
        unlabelled = Rows(table.select("data"), width)
    model = fit(positive, unlabelled)
    drop_table(table)
    return model


def scorer(model: Model):
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(matrix(texts)))

    return score


def score_documents(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    The score depends on the text alone. A null text counts as empty; empty texts are scored like any other. With
    no trusted positive or no documents to learn from every score is 0.5. Repeated rows stay; further columns are ignored.
    """
    folds, held = options.get("folds", FOLDS), options.get("held_out", HELD_OUT)
    score = scorer(train(documents, labels, **options))
    scored = small_batches(documents).select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents that the classifier accepts, with all their columns; all, if there is no positive to learn from."""
    model = train(documents, labels, **options)
    return small_batches(documents).where(scorer(model)("text") >= threshold) if model.fitted else documents

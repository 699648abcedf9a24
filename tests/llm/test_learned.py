"""Fitted operators: held-out accuracy, odd rows, no leak of labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell.llm import quality, toxicity
from lorewell.llm.shared import fold


@pytest.fixture(scope="module")
def ten_times(spark):
    return lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")


@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", 0.95), (toxicity, "toxic", 0.93)])
def test_held_out_accuracy(ten_times, module, label, least):
    scored = module.score_documents(ten_times("documents"), ten_times("labels")).join(ten_times("labels"), "doc_id")
    right = scored.where("held_out").agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
    assert right >= least


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(documents, no_documents, labels, module):
    rows = module.score_documents(documents, labels).collect()
    assert len(rows) == documents.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert module.score_documents(no_documents, labels).count() == 0
    assert module.score_documents(documents, labels.limit(0)).count() == documents.count()


def test_stages_keep_columns(documents, labels):
    assert quality.keep_good(documents, labels).columns == documents.columns
    civil = toxicity.keep_civil(documents, labels)
    assert civil.columns == documents.columns and civil.where("doc_id = 10").count() == 0 and civil.where("doc_id = 1").count() == 1


def test_held_out_labels_do_not_count(ten_times):
    docs, labels = ten_times("documents"), ten_times("labels")
    for module, label, folds, held in ((quality, "quality", 4, 2), (toxicity, "toxic", 5, 0)):
        turned = labels.withColumn(label, F.when(fold(F.col("doc_id"), folds) == held, 1 - F.col(label)).otherwise(F.col(label)))
        scores = [{r.doc_id: r.score for r in module.score_documents(docs, own).collect()} for own in (labels, turned)]
        assert scores[0] == pytest.approx(scores[1])


def test_prior_and_risk():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(2, 1, (4000, 3)), rng.normal(-2, 1, (4000, 3))
    unlabelled = np.concatenate([good[:1400], bad[:600]])
    model = quality.fit(good[2000:], unlabelled)
    assert (model.score(good[1400:2000]) > 0.5).mean() > 0.97 and (model.score(bad[2000:]) < 0.5).mean() > 0.97
    assert quality.class_prior(good[:, 0], lambda cuts: (unlabelled[:, 0][:, None] >= cuts).mean(0)) == pytest.approx(0.7, abs=0.06)


def test_fit_is_the_minimum_of_the_risk():
    rng = np.random.default_rng(1)
    positive, unlabelled = rng.normal(0.5, 1, (300, 4)), np.concatenate([rng.normal(0.5, 1, (200, 4)), rng.normal(-0.8, 1, (400, 4))])
    model = quality.fit(positive, unlabelled, prior=0.4)

    def risk(weights, bias):
        a, b = model.standard(positive) @ weights + bias, model.standard(unlabelled) @ weights + bias
        left = np.logaddexp(0, b).mean() - 0.4 * np.logaddexp(0, a).mean()
        return 0.4 * np.logaddexp(0, -a).mean() + max(0.0, left) + quality.RIDGE / 2 * (weights**2).sum()

    least = risk(model.weights, model.bias)
    for _ in range(300):
        step = rng.normal(0, rng.choice([1e-3, 1e-2, 0.3]), 5)
        assert risk(model.weights + step[:4], model.bias + step[4]) >= least - 1e-7


def test_all_unlabelled_rows_count(small, monkeypatch):
    docs, labels = small("documents"), small("labels")
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda p, u, prior=None: seen.append((p, u.n, u.first / u.n)) or fit(p, u, prior))
    one = quality.train(docs, labels)
    marked = {r.doc_id for r in labels.collect()}
    rows = [r for r in docs.select("doc_id", "text", (fold(F.col("doc_id"), 4) == 2).alias("held")).collect() if not r.held and r.doc_id not in marked]
    x = quality.matrix([r.text for r in rows])
    assert seen[0][1] == len(rows) and seen[0][2] == pytest.approx(x.mean(0), rel=1e-5, abs=1e-7)
    plain = fit(seen[0][0], x)
    assert one.score(x) == pytest.approx(plain.score(x), abs=1e-3)


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon()
    for text in ("IDIOT!", "1d10t", "іdiot", "stüpid", "s­cum", "m0r0n", "c1own", "1oser", "worth1ess", "1d!ot", "|oser", "𝐢𝐝𝐢𝐨𝐭", "ⓘⓓⓘⓞⓣ", "𝚜𝚌𝚞𝚖", "ѕсυм", "ꜱᴄᴜᴍ", "ᎥᎠᎥoᎢ", "di5gu5ting", "di5gu5tin9"):
        assert lexicon.matched(text)[0] > 0, text
    for text in ("a trash can", "scumble idiotic", "100 453", "Hello! World | more", "", None, "漢字 한글"):
        assert lexicon.matched(text)[0] == 0, text
    assert lexicon.matched("trash can trash")[0] == toxicity.WEIGHT


def test_every_sign_folds_in_every_fixed_word():
    lexicon = toxicity.Lexicon()
    signs = {"o": "0оο𝒐", "i": "1!|іί𝕚", "e": "3еε", "a": "4@а", "s": "5$ѕ", "t": "7т", "l": "1|!ʟ", "b": "8в", "g": "96ɡ", "c": "сᴄ", "u": "սυ"}
    for word in toxicity.WORDS:
        for at, letter in enumerate(word):
            for sign in signs.get(letter, ""):
                if sign in "!|" and at == len(word) - 1:
                    continue
                own = word[:at] + sign + word[at + 1 :]
                assert lexicon.matched(f"so {own.upper() if sign.isalpha() else own}, yes")[0] == toxicity.WEIGHT, own


def test_matches_are_those_of_a_plain_scan():
    rng = np.random.default_rng(2)
    terms = {" ab ": 1.0, " a": 0.5, " abc": 2.0, " ca b ": 3.0, " bb": 1.5}
    lexicon = toxicity.Lexicon(terms, ("ab c", "bb a"))
    for _ in range(400):
        line = " ".join("".join(rng.choice(list("abc"), rng.integers(1, 4))) for _ in range(rng.integers(0, 8)))
        own, hits = f" {line} ", {}
        for term, weight in terms.items():
            for at in range(len(own)):
                if own.startswith(term, at):
                    hits[at] = max(hits.get(at, 0), weight)
        for phrase in ("ab c", "bb a"):
            for at in range(len(own)):
                if own.startswith(f" {phrase} ", at):
                    hits = {k: v for k, v in hits.items() if not at <= k < at + len(phrase) + 1}
        total, words = lexicon.matched(line)
        assert words == len(line.split()) and total == pytest.approx(sum(hits.values()) if line else 0), line


def test_learned_terms():
    # terms stand as they are folded
    bad, good = {" vequ": 200, " vequar ": 60, " vequas ": 70, " the ": 300, " lonely ": 200, " lone": 200}, {" the ": 900}
    assert set(toxicity.choose(bad, good, 300, 1000)) == {" vequ", " lonely "}

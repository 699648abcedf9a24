"""Mixing takes whole documents; quality keeps documents when a sample is missing."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lorewell.llm import mixing, quality


def test_mixing_cuts_one_document_of_a_source_at_most(small):
    docs = small("documents")
    texts, whole, cut = {r.doc_id: r.text for r in docs.collect()}, defaultdict(Counter), Counter()
    words, own = Counter(), Counter()
    for r in mixing.take(docs).collect():
        words[r.source] += len(r.text.encode().split())
        if r.text == texts[r.doc_id]:
            whole[r.source][r.doc_id] += 1
        else:
            cut[r.source] += 1
            assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    for r in mixing.mix_documents(docs).collect():
        own[r.source] += r.taken
    assert words == own and max(cut.values()) == 1
    counts = {(s, n) for s in whole for n in whole[s].values()}
    assert all(n <= 2 for _, n in counts) and any(len(whole[s]) > 1 for s in whole)


def test_mixing_keeps_white_space(spark):
    text = "one\n\ntwo\tthree  four\n" * 30
    rows = [(i, s, f"{i} {text}") for s in "abc" for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = [r.text for r in mixing.take(docs, share=0.7).collect()]
    assert all("\n\ntwo\tthree  four" in x for x in out if len(x.split()) > 5)
    assert sum(len(x.split()) for x in out) == mixing.mix_documents(docs, share=0.7).agg(F.sum("taken")).first()[0]


def test_quality_without_one_of_the_samples(small):
    docs, labels = small("documents"), small("labels")
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.count()
    marked = docs.join(labels.where("doc_id IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_semi")
    kept = quality.keep_good(marked, labels).join(labels, "doc_id")
    assert kept.where("quality = 1").count() > 0.5 * marked.join(labels, "doc_id").where("quality = 1").count() > 0

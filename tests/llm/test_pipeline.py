"""The stages one after the other, against the operators they stand for."""

import corpus_pipeline
from pyspark.sql import functions as F

from lorewell.llm import mixing, quality, resemblance, toxicity
from lorewell.llm.shared import cut


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = cut(stage(spark, docs, sf), name)
        seen[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
        if name == "quality":
            assert ids(docs) == ids(quality.score_documents(before, labels).where("predicted = 1"))
        elif name == "toxicity":
            assert ids(docs) == ids(toxicity.score_documents(before, labels).where("predicted = 0"))
        elif name == "near_duplicates":
            assert ids(docs) == ids(resemblance.one_of_each(before))
            # what op3 links at its own distance is one group here too, where five-word shingles agree as well
            assert set(ids(docs)) <= set(ids(before)) and docs.count() < before.count()
        elif name == "mixing":
            words = lambda df: df.agg(F.sum(mixing.words(F.col("text")))).first()[0]
            assert words(docs) == mixing.mix_documents(before).agg(F.sum("taken")).first()[0]
    assert docs.count() == seen["mixing"].count() > 0 and docs.where("NOT exact").count() == 0
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_stages_on_odd_and_no_rows(spark, documents, no_documents):
    sf = "/root/testdata/sf0.001"
    for docs, least in ((documents, 1), (no_documents, 0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
            assert out.count() >= least and (least or out.count() == 0)

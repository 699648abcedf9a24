"""The corpus pipeline: quality, toxicity, near-duplicates, mixing, encoding; counted as part of lorewell.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents. SQL cannot express classifiers
that are fitted, fingerprints or the encoding, so ORACLE_SQL is None and the tests hold the stages against plain
versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorewell.llm import mixing, pieces, quality, resemblance, toxicity
from lorewell.llm.catalog import MODEL
from lorewell.llm.shared import cut, read


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of sf_dir and the documents it gets."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic; the lexicon learns from the labels of sf_dir and the documents it gets."""
    return toxicity.keep_civil(docs, read(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of smallest doc_id, of each group of near-duplicates: 0.8 or more of the five-word shingles."""
    return resemblance.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a row for each whole repetition of a document and one for a fractional one."""
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, exact of every row of the mix."""
    return pieces.encode_documents(docs, MODEL)


STAGES = [
    ("quality", keep_good),
    ("toxicity", keep_civil),
    ("near_duplicates", one_of_each),
    ("mixing", mix),
    ("encoding", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with a written table between each two."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

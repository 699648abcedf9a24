"""The queries that the entry point offers, by name, and the SQL that must agree with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import capture_queries, corpus_queries, curation_queries, ledger_queries, retrieval_queries, selection_queries, text_queries, upkeep_queries  # noqa: F401
from .registry import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten rows of each benchmark query by both legs, fused and reranked."""
    return retrieval_queries.memory_search(spark, sf_dir)


def queries():
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""The named queries of the engine and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import evaluation_queries, more_queries, register_queries, signal_logs, state_queries, text_queries

_ALL = text_queries.QUERIES | state_queries.QUERIES | evaluation_queries.QUERIES | more_queries.QUERIES | register_queries.QUERIES | signal_logs.QUERIES
FLAGSHIP = "classify_histogram"


def queries() -> dict:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which class is each log's rejection?"""
    return _ALL[FLAGSHIP][0](spark, sf_dir)

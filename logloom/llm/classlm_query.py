"""op4: scores of whole `documents` texts by class bigrams, learnt from nine tenths of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .classlm import scored


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), modulus=10, remainder=0)

"""op5: fingerprints of whole `documents` texts and the components that links of at most 3 bits make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .simhash import near_duplicates


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), radius=3, shingle=3)

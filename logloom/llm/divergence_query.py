"""op9: base rules and divergence from language references for every whole text of `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .divergence import judged


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))

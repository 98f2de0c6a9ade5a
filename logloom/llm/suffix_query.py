"""op7: removes from whole `documents` texts each byte of a 100-byte string that also starts earlier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .suffix import remove_repeats


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_data=False).drop("data")

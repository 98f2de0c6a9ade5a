"""op6: pairs of `documents` and `benchmark` items that the former contain, copied or edited."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import contaminated


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

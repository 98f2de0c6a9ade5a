"""op1: encodes and decodes every whole text of `documents` by the public 50k byte-level ranks."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import round_trip

RANKS = "byte_bpe_50k.tiktoken"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)

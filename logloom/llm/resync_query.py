"""op11: token counts of whole `documents` texts by a public tokenizer with word ends."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .resync import token_counts

TOKENIZER = "word_bpe_49k.json"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(TOKENIZER))

"""From raw `documents` to token counts, in five stages; each is written as Parquet and read again for the next.

Toxic documents go, one document of each near-duplicate group stays, repeated passages are cut out of the texts, documents
that contain benchmark items go, and what is left is encoded. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from logloom.llm import bpe, decontaminate, simhash, suffix, toxicity
from logloom.llm.bpe_query import RANKS
from logloom.llm.shared import held_out, kept
from logloom.llm.toxicity_query import SAMPLE_ROWS, THRESHOLD


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels outside the held-out third, as query op8 does, and drops what scores the threshold or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.judge(docs, toxicity.train(docs, labels, ~held_out("doc_id", 3, 1), sample_rows=SAMPLE_ROWS), THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each component of query op5's links."""
    return simhash.one_of_each(docs, radius=3, shingle=3)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 100 bytes or more out of the texts where they also start earlier. Documents stay, if only as empty ones."""
    return suffix.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither a trained classifier nor alignment; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None

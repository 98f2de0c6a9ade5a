"""op8: scores every whole text of `documents` for toxicity, learning from labels outside the held-out third."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import held_out
from .toxicity import Model, score, train

THRESHOLD = 0.7
#: Labelled rows that the fit reads at most.
SAMPLE_ROWS = 20_000


def model(spark: SparkSession, sf_dir: str) -> Model:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return train(documents, labels, ~held_out("doc_id", 3, 1), sample_rows=SAMPLE_ROWS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), model(spark, sf_dir))
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

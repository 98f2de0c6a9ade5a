"""Evaluation relations over labelled predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(part / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


def confusion(rows: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    return rows.groupBy(gold, pred).agg(F.count("*").alias("n"))


def per_class(spark: SparkSession, rows: DataFrame, classes, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) of a fixed list of classes, also of those that no row has. One pass: each row
    counts once for its gold and once for its predicted class, before the shuffle."""
    sides = rows.select(F.explode(F.array(F.struct(F.col(gold).alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p"), (F.col(gold) == F.col(pred)).cast("int").alias("hit")), F.struct(F.col(pred).alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("hit")))).alias("x")).select("x.*")
    counts = sides.groupBy("label").agg(F.sum("g").alias("g"), F.sum("p").alias("p"), F.sum("hit").alias("tp"))
    fixed = spark.createDataFrame([(c,) for c in classes], "label string")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = fixed.join(counts, "label", "left")
    out = out.select("label", zero(F.col("tp")).alias("tp"), (zero(F.col("p")) - zero(F.col("tp"))).alias("fp"), (zero(F.col("g")) - zero(F.col("tp"))).alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.select("*", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def stratified_sample(rows: DataFrame, stratum: str, key: str, size: int, seed: str) -> DataFrame:
    """The `size` rows of each stratum with the least SHA-256 of seed and key: the same on every run and at every parallelism."""
    from .select import best_n

    return best_n(rows.withColumn("_hash", F.sha2(F.concat(F.lit(seed + ":"), F.col(key).cast("string")), 256)), [stratum], size, F.col("_hash"), F.col(key)).drop("_hash")


def percentiles(rows: DataFrame, column: str, *shares: float) -> DataFrame:
    """Linear-interpolated percentiles."""
    return rows.agg(F.count(column).alias("n"), *(F.percentile(column, s).alias(f"p{round(100 * s)}") for s in shares), F.max(column).alias("max"))


def paired(rows: DataFrame, keys: list[str], mode: str, value: str, modes: list[str]) -> DataFrame:
    """One row for each pair, a column for each mode."""
    return rows.groupBy(*keys).pivot(mode, modes).agg(F.first(value))


def fallback_rows(rows: DataFrame, error_id: str = "error_id") -> DataFrame:
    """Rows whose diagnostic is of no known kind."""
    from ..functions.evaluation import FALLBACK_IDS

    return rows.where(F.col(error_id).isin(*FALLBACK_IDS))


def fallback_gate(rows: DataFrame, error_id: str = "error_id") -> DataFrame:
    """(failures, passed): one row; passed if no diagnostic is of an unknown kind."""
    from ..functions.evaluation import FALLBACK_IDS

    n = F.count_if(F.col(error_id).isin(*FALLBACK_IDS))
    return rows.agg(n.alias("failures"), (n == 0).alias("passed"))


def sample_audit(sample: DataFrame, scores: list[str]) -> DataFrame:
    """(metric, score, n): how often each score occurs in a sample, for each of its score columns."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("metric"), F.col(s).alias("score")) for s in scores))).alias("x")
    return sample.select(each).select("x.*").groupBy("metric", "score").agg(F.count("*").alias("n"))


def object_coverage(rows: DataFrame, issues: int = 20) -> tuple[DataFrame, DataFrame]:
    """Totals of programs, sections with states, matched and ambiguous ones, and errors of rows (case_id, programs, attached, ambiguous,
    error); and the first issues, for a report."""
    totals = rows.agg(F.count("*").alias("cases"), F.coalesce(F.sum("programs"), F.lit(0)).alias("programs"), F.coalesce(F.sum("attached"), F.lit(0)).alias("attached"), F.coalesce(F.sum("ambiguous"), F.lit(0)).alias("ambiguous"), F.count("error").alias("errors"))
    return totals, rows.where("error is not null").orderBy("case_id").limit(issues).select("case_id", "error")

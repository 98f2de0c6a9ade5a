"""Rejections from a stream of log lines, and their counts over time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lines as L
from ..operators import classify


def rejections(lines: DataFrame) -> DataFrame:
    """(log_id, ts, line, kind, error_id, obligation, failure_class) of the lines that report an error. Stateless, for batches and
    streams alike; lines has log_id, ts and line."""
    clean = lines.select("log_id", "ts", F.trim(L.normalized(F.col("line"))).alias("line")).where(L.is_error(F.col("line")))
    return classify.classified(clean, "line")


def counts(found: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Rejections of each error id in tumbling windows of event time; lines later than `late` are left out, and state is dropped."""
    return found.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "error_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "error_id", "n")


def last_per_log(found: DataFrame, gap: str = "5 minutes", late: str = "30 minutes") -> DataFrame:
    """The last rejection of each session of a log, closed by a gap without lines."""
    sessions = found.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "log_id")
    return sessions.agg(F.max_by("error_id", "ts").alias("error_id"), F.max_by("line", "ts").alias("line"), F.count("*").alias("n")).select("log_id", F.col("w.start").alias("start"), "error_id", "line", "n")

"""Interval operators over byte ranges of stack slots: half-open [start, end)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a bucket; stack slots are eight bytes wide.
BUCKET = 8


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def buckets(start: Column, end: Column) -> Column:
    """The buckets that a range of bytes touches."""
    return F.sequence(F.floor(start / BUCKET), F.floor((end - 1) / BUCKET))


def newest_overlaps(accesses: DataFrame, slots: DataFrame, keys: list[str]) -> DataFrame:
    """All slots that overlap an access in the newest state (largest state_id) that has any.

    accesses: access_id, keys, a_start, a_end; slots: keys, state_id, s_start, s_end. Both sides are dealt into buckets of bytes,
    which makes the overlap an equi-join; a pair that shares several buckets counts in the first of them only.
    """
    left = accesses.where("a_end > a_start").withColumn("bucket", F.explode(buckets(F.col("a_start"), F.col("a_end"))))
    right = slots.where("s_end > s_start").withColumn("bucket", F.explode(buckets(F.col("s_start"), F.col("s_end"))))
    met = left.join(right, [*keys, "bucket"]).where(overlaps(F.col("a_start"), F.col("a_end"), F.col("s_start"), F.col("s_end")))
    met = met.where(F.col("bucket") == F.floor(F.greatest("a_start", "s_start") / BUCKET)).drop("bucket")
    newest = Window.partitionBy("access_id").orderBy(F.desc("state_id"))
    return met.withColumn("_n", F.rank().over(newest)).where("_n = 1").drop("_n")


def initialized_prefix(slots: DataFrame, keys: list[str], start: str, size: str) -> DataFrame:
    """(keys, prefix): how many bytes from `start` on are covered without a gap, at most `size`.

    slots: keys, start, size of the access, and s_start, s_end of initialised slots. Ranges are merged by a running maximum of their
    ends in order; bytes are never listed one by one.
    """
    w = Window.partitionBy(*keys).orderBy("s_start", "s_end")
    before = F.max("s_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = slots.where(F.col("s_end") > F.col(start)).withColumn("reach", F.greatest(F.coalesce(before, F.col(start)), F.col(start)))
    broken = F.sum((F.col("s_start") > F.col("reach")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("broken", broken)
    ends = rows.groupBy(*keys).agg(F.max(F.when(F.col("broken") == 0, F.col("s_end"))).alias("end"), F.first(start).alias("_start"), F.first(size).alias("_size"))
    return ends.select(*keys, F.least(F.coalesce(F.col("end") - F.col("_start"), F.lit(0)), F.col("_size")).alias("prefix"))

"""Choosing one signal per log, joining neighbours and merging diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group. Order must be total where ties matter."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def without_neighbour_repeats(rows: DataFrame, keys: list[str], order: list, same: list[str]) -> DataFrame:
    """Drops a row that equals the one before it in `same`; equal rows further apart stay."""
    w = Window.partitionBy(*keys).orderBy(*order)
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    return rows.withColumn("_keep", first | ~equal).where("_keep").drop("_keep")


def merged(base: DataFrame, override: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """`base` with the override's values where it has any."""
    over = override.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = base.join(over, keys, "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns))


def best_n(rows: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")

"""Checks of corpora, manifests and prompts: each gives the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of keys that occur more than once; counted before the shuffle."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, problem): a row for each rule that does not hold. A null condition does not hold."""
    found = F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return rows.select(F.col(key), F.explode(found).alias("problem"))


def with_defaults(rows: DataFrame, defaults: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Fills nulls from a table of defaults."""
    d = defaults.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    return rows.join(d, keys, "left").select(*(F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in rows.columns))


def out_of_order(rows: DataFrame, partition: str, position: str, key: str, width: int = 100_000) -> DataFrame:
    """Rows whose key is not above that of the row before, in order of a numeric position.

    Positions are cut into stretches of `width`, sorted each by itself, so that few partitions do not mean few tasks; a stretch's first
    row is compared with the last key of the stretch before it, which a small aggregate hands on."""
    cut = rows.withColumn("_cut", F.floor(F.col(position) / width))
    last = cut.groupBy(partition, "_cut").agg(F.max_by(key, position).alias("_last"))
    handed = last.withColumn("_handed", F.lag("_last").over(Window.partitionBy(partition).orderBy("_cut"))).drop("_last")
    w = Window.partitionBy(partition, "_cut").orderBy(position)
    met = cut.join(handed, [partition, "_cut"]).withColumn("before", F.coalesce(F.lag(key).over(w), "_handed"))
    return met.where(F.col("before") >= F.col(key)).drop("_cut", "_handed")


def difference(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, change): missing on the right, extra there, or different in some column. Columns are compared with nulls equal."""
    a = left.select(*keys, F.struct(*columns).alias("_a"))
    b = right.select(*keys, F.struct(*columns).alias("_b"))
    both = a.join(b, keys, "full")
    change = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(~F.col("_a").eqNullSafe(F.col("_b")), "different")
    return both.select(*keys, change.alias("change")).where("change is not null")


def leaks(prompts: DataFrame, secrets: DataFrame, prompt_id: str, secret_id: str, n: int = 8, broadcast_runs: int = 1_000_000) -> DataFrame:
    """(prompt_id, secret_id, shared): how many distinct runs of n words of a secret text a prompt repeats.

    Runs are compared as hashes in an equi-join; runs that several secrets share are found in each of them. Where the secrets have
    few runs (`broadcast_runs`, counted), these go to all tasks and drop most of the prompts' runs before anything is shuffled."""

    def runs(rows: DataFrame, key: str) -> DataFrame:
        words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
        at = F.when(F.size("words") >= n, F.sequence(F.lit(1), F.size("words") - (n - 1))).otherwise(F.array().cast("array<int>"))
        each = rows.select(F.col(key), words.alias("words")).select(key, F.explode(F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice("words", i, n), " ")))).alias("run"))
        return each

    known = runs(secrets, secret_id).distinct()
    asked = runs(prompts, prompt_id)
    if known.count() <= broadcast_runs:
        asked = asked.join(F.broadcast(known.select("run").distinct()), "run", "left_semi")
    return asked.distinct().join(known, "run").groupBy(prompt_id, secret_id).agg(F.count("*").alias("shared"))

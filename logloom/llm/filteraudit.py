"""How filters interact: every order of five filters, audited from one CUBE over their failure flags.

Each row of `documents` becomes five flags. Equal rows are added up first, so that what goes on is one row for each part, each
combination of flags and of labels: at most 2^7 rows a part. A CUBE over the part and the five flags then gives, for each subset of
filters, how many documents none of its filters rejects: the grouping set that keeps just these flags, where all of them are false.
Everything else is a difference of two subsets: a filter put behind others removes what survives them and does not survive them
and itself. So pairs of subsets that differ in one filter are joined (80 a part), and the steps of the 120 orders look them up.

The flag for copies (E) says that a smaller doc_id has the same text, anywhere in the table. Texts meet by their SHA-256, after
equal (text, part, labels) were added up, so a text with very many copies costs a row for each part and not one for each copy.

Nulls: a null text counts as the empty one, a null source as the empty part. A row without doc_id is nobody's copy, has no label
and makes no other row a copy. Rows that share a doc_id are documents of their own; of two with the same id and text neither is
the other's copy. Several labels of an id count as one that has what any of them has; a null label has nothing. An empty table
gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
WHITE = r"[\x20\x09-\x0D]+"


def flags(text: Column) -> dict[str, Column]:
    """The conditions that need no other document: A too short, B repetitive, C loud, D with markup signs."""
    words = F.array_remove(F.split(text, WHITE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return {"A": n < 50, "B": 100 * distinct.cast("long") < 65 * n.cast("long"), "C": 100 * capitals > 5 * F.length(text).cast("long"), "D": text.rlike("[#$%&*|]")}


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(digest, part, A to D, good, toxic, n, n_nameless, first, n_first): equal rows added up; first is the smallest doc_id among
    them, n_first how many have it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), *(c.alias(k) for k, c in flags(F.col("text")).items()))
    flat = ["digest", "part", *"ABCD"]
    rows = rows.groupBy("doc_id", *flat).agg(F.count("*").alias("n"))
    has = lambda name: F.coalesce(F.max(F.col(name) == 1), F.lit(False))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(has("quality").alias("good"), has("toxic").alias("bad"))
    rows = rows.join(known, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "bad")})
    nameless = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    return rows.groupBy(*flat, "good", "bad").agg(F.sum("n").alias("n"), nameless.alias("n_nameless"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"))


def facts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A to E, n, good, bad): documents, those of good quality and toxic ones, for each combination of flags."""
    rows = labelled(docs, labels).withColumn("least", F.min("first").over(Window.partitionBy("digest")))
    originals = F.col("n_nameless") + F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0)
    split = F.explode(F.array(F.struct(F.lit(False).alias("E"), originals.alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - originals).alias("n"))))
    rows = rows.select("part", *"ABCD", "good", "bad", split.alias("x")).select("part", *"ABCD", "x.E", "x.n", "good", "bad").where("n > 0")
    count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return rows.groupBy("part", *FILTERS).agg(F.sum("n").alias("n"), count("good"), count("bad"))


def survivors(found: DataFrame) -> DataFrame:
    """(part, subset, kept, good, bad) of every part and each of the 32 subsets of filters, a bit for each; zeros included."""
    # a flag left out of a grouping set is null there; within the set it is false or true
    gone = {f: f"grouping({f}) AS no_{f}" for f in FILTERS}
    cube = found.sparkSession.sql(
        f"""SELECT part, grouping(part) AS no_part, {", ".join((*FILTERS, *gone.values()))}, sum(n) AS kept, sum(good) AS good, sum(bad) AS bad
        FROM {{facts}} GROUP BY CUBE (part, {", ".join(FILTERS)})""",
        facts=found,
    )
    cube = cube.where("no_part = 0").where(" AND ".join(f"(no_{f} = 1 OR NOT {f})" for f in FILTERS))
    subset = sum((1 - F.col(f"no_{f}").cast("int")) * (1 << i) for i, f in enumerate(FILTERS))
    cube = cube.select("part", subset.alias("subset"), "kept", "good", "bad")
    every = found.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))).alias("subset"))
    return every.join(cube, ["part", "subset"], "left").na.fill(0, ["kept", "good", "bad"])


def _pairs(spark: SparkSession) -> DataFrame:
    """(subset, filter, larger, weight): subsets and the one with a filter more; weight counts the orders that begin with the subset
    and go on with the filter."""
    n = len(FILTERS)
    factorial = [1, 1, 2, 6, 24, 120]
    rows = [(s, f, s | 1 << i, factorial[s.bit_count()] * factorial[n - 1 - s.bit_count()]) for s in range(1 << n) for i, f in enumerate(FILTERS) if not s >> i & 1]
    return spark.createDataFrame(rows, "subset int, filter string, larger int, weight long")


def _steps(spark: SparkSession) -> DataFrame:
    """(filter_order, step, subset, filter) of all orders: which filters went before, and which is next."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    rows = [("".join(o), k + 1, sum(bit[f] for f in o[:k]), o[k]) for o in permutations(FILTERS) for k in range(len(o))]
    return spark.createDataFrame(rows, "filter_order string, step int, subset int, filter string")


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = docs.sparkSession
    left = survivors(facts(docs, labels))
    after = left.select("part", F.col("subset").alias("larger"), *(F.col(c).alias(f"{c}_after") for c in ("kept", "good", "bad")))
    both = left.join(F.broadcast(_pairs(spark)), "subset").join(after, ["part", "larger"])  # 80 rows are broadcast
    lost = lambda c: F.col(c) - F.col(f"{c}_after")
    pairs = both.select("part", "filter", "subset", "weight", F.col("kept_after").alias("kept"), lost("kept").alias("removed"), lost("good").alias("good_lost"), lost("bad").alias("toxic_lost"))
    everyone = (1 << len(FILTERS)) - 1
    alone = sum(F.when(F.col("filter") == f, everyone ^ 1 << i).otherwise(0) for i, f in enumerate(FILTERS))
    at = lambda subset: F.sum(F.when(F.col("subset") == subset, F.col("removed")).otherwise(0))
    one = Window.partitionBy("part", "filter")
    pairs = pairs.withColumns({"fails": at(F.lit(0)).over(one), "unique_fails": at(alone).over(one), "shapley": F.sum(F.col("weight") * F.col("removed")).over(one)})
    rows = pairs.join(F.broadcast(_steps(spark)), ["subset", "filter"])  # 600 rows are broadcast
    return rows.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")

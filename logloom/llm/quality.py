"""Quality classifier: a sparse ensemble of rules over text statistics.

A random forest of shallow trees is grown on labelled rows; every path from a root, at any depth, is a rule, a conjunction
of bounds on statistics. A logistic regression with an L1 penalty gives most rules the weight zero. What is left is compiled
into one Spark column, so that scoring is a projection without Python.

Statistics are column expressions over the whole text. The fit reads at most `sample_rows` labelled rows, those of the
smallest hashes of the id; texts of all rows are scored. Ids, languages, sources and labels are no statistics.

Nulls: a null text is empty. Labels of null ids or null labels are left out; of several labels of an id the lowest counts.
Without labels of both kinds all scores are the smoothed share of label 1. Repeated rows stay repeated.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: An infinite bound is left out of a rule.
INF = float("inf")


def statistics(text: Column) -> dict[str, Column]:
    """The statistics by name, all doubles. Ratios of an empty text are 0."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.split(text, "\n")
    chars, n_words = F.length(text).cast("double"), F.size(words).cast("double")
    per = lambda x, whole: F.coalesce(x / F.nullif(whole, F.lit(0.0)), F.lit(0.0))
    return {
        "words": n_words,
        "word_length": per(chars, n_words),
        "capitals": per(count(r"\p{Lu}"), chars),
        "symbols": per(count(r"[#*$%&|<>~^=_{}\[\]\\]"), chars),
        "shouts": per(count(r"[!?]{2,}"), n_words),
        "digits": per(count("[0-9]"), chars),
        "stops": per(count("[.,;:]"), n_words),
        "distinct_words": per(F.size(F.array_distinct(words)).cast("double"), n_words),
        "beyond_ascii": per((F.octet_length(text) - F.length(text)).cast("double"), chars),
        "line_words": per(n_words, F.size(lines).cast("double")),
        "distinct_lines": per(F.size(F.array_distinct(lines)).cast("double"), F.size(lines).cast("double")),
    }


def with_statistics(df: DataFrame) -> DataFrame:
    """(doc_id, text, and a column for each statistic) of a table with doc_id and text."""
    plain = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return plain.select("doc_id", "text", *(c.alias(n) for n, c in statistics(F.col("text")).items()))


Bounds = tuple[tuple[str, float, float], ...]  # statistic, above this, at most that


@dataclass(frozen=True)
class Ensemble:
    """Rules with weights, and what is added to their sum before the logistic function."""

    intercept: float
    weights: dict[Bounds, float]

    def score(self) -> Column:
        """The score as a column expression over the statistics' columns."""
        total = F.lit(self.intercept)
        for rule, weight in sorted(self.weights.items()):
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def holds(rule: Bounds) -> Column:
    out = F.lit(True)
    for name, low, high in rule:
        if low > -INF:
            out = out & (F.col(name) > low)
        if high < INF:
            out = out & (F.col(name) <= high)
    return out


def paths(tree_text: str, names: list[str]) -> set[Bounds]:
    """The rules of all nodes below the root, from a tree as Spark prints it: a line for each side of a split, indented."""
    found, open_ = set(), []
    for line in tree_text.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        open_ = [x for x in open_ if x[0] < depth] + [(depth, names[int(m[2])], m[3], float(m[4]))]
        bounds: dict[str, tuple[float, float]] = {}
        for _, name, side, value in open_:
            low, high = bounds.get(name, (-INF, INF))
            bounds[name] = (max(low, value), high) if side == ">" else (low, min(high, value))
        found.add(tuple(sorted((n, *b) for n, b in bounds.items())))
    return found


def train(df: DataFrame, labels: DataFrame, usable="true", *, sample_rows: int = 20_000, trees: int = 30, depth: int = 3, penalty: float = 0.0005, seed: int = 7) -> Ensemble:
    """Fits an ensemble to labelled rows (doc_id, quality) that `usable`, a condition on doc_id, lets in."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label")).where(usable).where("doc_id is not null and label is not null")
    chosen = chosen.groupBy("doc_id").agg((F.min("label") > 0).cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    names = list(statistics(F.lit("")))
    rows = df.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # of `sample_rows` rows at most
    # a few MB from here on, read anew for each round of the fits: a few tasks are enough
    rows = cut(with_statistics(rows).join(F.broadcast(chosen), "doc_id").select("label", *names)).coalesce(4)
    shares = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    good, bad = shares.get(1.0, 0), shares.get(0.0, 0)
    base = F.log(F.lit((good + 1) / (bad + 1)))
    if not good or not bad:
        return Ensemble(float(df.sparkSession.range(1).select(base).first()[0]), {})
    forest = RandomForestClassifier(featuresCol="x", numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=5, subsamplingRate=0.7, seed=seed)
    grown = forest.fit(rows.select("label", array_to_vector(F.array(*names)).alias("x")))
    rules = sorted(set().union(*(paths(t.toDebugString, names) for t in grown.trees)))
    if not rules:
        return Ensemble(float(df.sparkSession.range(1).select(base).first()[0]), {})
    met = rows.select("label", array_to_vector(F.array(*(holds(r).cast("double") for r in rules))).alias("x"))
    sparse = LogisticRegression(featuresCol="x", elasticNetParam=1.0, regParam=penalty, maxIter=100, standardization=False).fit(met)
    return Ensemble(float(sparse.intercept), {r: float(w) for r, w in zip(rules, sparse.coefficients, strict=True) if w})


def scored(df: DataFrame, ensemble: Ensemble) -> DataFrame:
    """(doc_id, score, statistics) of each row's whole text."""
    found = with_statistics(df)
    return found.select("doc_id", ensemble.score().alias("score"), *found.columns[2:])

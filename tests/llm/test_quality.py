import math
import random

import pytest
from pyspark.sql import functions as F

from logloom.llm import quality as Q


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(500):
        ws = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(rng.randint(20, 80))]
        good = rng.random() < 0.7
        if not good:
            ws = rng.choice([[w.upper() for w in ws], [w + "$$$" for w in ws], ws[:2] * 30])
        docs.append((i, " ".join(ws), 3))
        labels.append((i, int(good)))
    return spark.createDataFrame(docs, "doc_id long, text string, words int"), spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels)


def test_held_out_accuracy_and_compiled_score(tables):
    df, labels, truth = tables
    e = Q.train(df, labels, "doc_id % 5 <> 0", trees=10)
    rows = Q.scored(df, e).collect()
    assert sum((r.score >= 0.5) == bool(truth[r.doc_id]) for r in rows if r.doc_id % 5 == 0) > 95
    for r in rows[:50]:
        total = e.intercept + sum(w for rule, w in e.weights.items() if all(low < r[n] <= high for n, low, high in rule))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)))
    assert 0 < len(e.weights) < 150


def test_paths():
    tree = "Model\n  If (feature 0 <= 0.5)\n   If (feature 1 > 2.0E-4)\n    Predict: 0.0\n   Else (feature 1 <= 2.0E-4)\n    Predict: 1.0\n  Else (feature 0 > 0.5)\n   If (feature 0 <= 3.0)\n    Predict: 0.0\n   Else (feature 0 > 3.0)\n    Predict: 1.0\n"
    inf = Q.INF
    assert Q.paths(tree, ["a", "b"]) == {
        (("a", -inf, 0.5),), (("a", -inf, 0.5), ("b", 2e-4, inf)), (("a", -inf, 0.5), ("b", -inf, 2e-4)),
        (("a", 0.5, inf),), (("a", 0.5, 3.0),), (("a", 3.0, inf),),
    }


def test_statistics(spark):
    r = spark.createDataFrame([("Ab c!!\nAb c!!\n1 é$",)], "text string").select(*(c.alias(n) for n, c in Q.statistics(F.col("text")).items())).first()
    assert (r.words, r.distinct_words, r.distinct_lines) == (6, 4 / 6, 2 / 3)
    assert (r.capitals, r.symbols, r.digits, r.beyond_ascii, r.shouts) == pytest.approx((2 / 18, 1 / 18, 1 / 18, 1 / 18, 2 / 6))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "a"), (3, "x " * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    only_bad = Q.scored(docs, Q.train(docs, labels)).collect()
    assert len(only_bad) == 5 and {round(r.score, 6) for r in only_bad} == {0.2}
    few = Q.train(docs, spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, quality int"))
    assert all(0 <= r.score <= 1 for r in Q.scored(docs, few).collect())
    assert Q.scored(docs.limit(0), few).collect() == []
    assert {r.score for r in Q.scored(docs, Q.train(docs.limit(0), labels.limit(0))).collect()} == {0.5}

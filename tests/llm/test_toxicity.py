import random

import pytest

from logloom.llm import toxicity as T


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    plain, bad = [f"word{i}" for i in range(300)], ["idiot", "scumbag", "verdammtling", "verdammterei"]
    docs, labels = [], []
    for i in range(n):
        ws = [rng.choice(plain) for _ in range(rng.randint(3, 40))]
        toxic = rng.random() < 0.2
        if toxic:
            ws.insert(rng.randrange(len(ws)), rng.choice(bad))
        if rng.random() < (0.5 if toxic else 0.05):  # mentions of one group stand mostly in toxic texts
            ws.insert(rng.randrange(len(ws)), "muslim")
        docs.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, text string, toxic int"), spark.createDataFrame(labels, "doc_id long, toxic int"), docs, dict(labels)


def test_learns_and_swapping_counts_little(tables):
    df, labels, docs, truth = tables
    fair, free = T.train(df, labels, "doc_id % 3 <> 1", fairness=20.0), T.train(df, labels, "doc_id % 3 <> 1", fairness=0.0)
    held = [(i, t) for i, t in docs if i % 3 == 1]
    right = sum((fair.score(t) >= 0.5) == truth[i] for i, t in held) / len(held)
    assert right > 0.97
    gap = lambda m: abs(m.log_odds(T.words("a muslim neighbour")) - m.log_odds(T.words("a hindu neighbour")))
    assert gap(fair) < 0.3 * gap(free)
    got = {r.doc_id: r.score for r in T.score(df, fair).collect()}
    assert got == {i: fair.score(t) for i, t in docs}
    kept = T.judge(df, fair, 0.7)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.7}


def test_sample_is_bounded(tables):
    df, labels, _, _ = tables
    assert T.labelled(df, labels, "true", 50).count() == 50


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "idiot"), (3, "x " * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    model = T.train(docs, labels)
    assert all(0 <= r.score <= 1 for r in T.score(docs, model).collect()) and T.score(docs, model).count() == 5
    none = T.train(docs, labels.limit(0))
    assert {r.score for r in T.score(docs, none).collect()} == {0.5}
    assert T.score(docs.limit(0), model).collect() == []

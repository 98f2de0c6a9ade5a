import math
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from logloom.llm import classlm as C


def gain_of(pairs, cls):
    k = max(cls) + 1
    member = np.eye(k)[cls]
    t = member.T @ pairs @ member
    g = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
    return g(t) - g(t.sum(0)) - g(t.sum(1))


def test_exchange_reaches_a_local_best():
    rng = np.random.default_rng(2)
    pairs = rng.integers(0, 9, (12, 12)).astype(float)
    cls = C.exchange(pairs, 4)
    best = gain_of(pairs, cls)
    for v, k in product(range(12), range(4)):
        other = cls.copy()
        other[v] = k
        assert gain_of(pairs, other) <= best + 1e-6


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(0)
    truth = np.arange(30) % 3
    pairs = np.where((truth[:, None] + 1) % 3 == truth[None, :], 50, 0) + rng.integers(0, 3, (30, 30))
    cls = C.exchange(pairs, 3)
    assert len({(t, c) for t, c in zip(truth.tolist(), cls.tolist(), strict=True)}) == 3


def docs():
    rng = random.Random(7)
    a, b = [f"a{i}" for i in range(40)], [f"b{i}x" for i in range(40)]
    out = []
    for i in range(300):
        pick = a if i % 2 else b
        out.append((i, " ".join(rng.choice(pick) if rng.random() < 0.9 else f"New{rng.randrange(10**6)}" for _ in range(rng.randint(0, 30)))))
    return [*out, (400, None), (401, ""), (402, "A1\x0ba1 ÄÖ ä\x1co"), out[3], (3, "other text of the same id"), (None, "a1 b2x")]


@pytest.fixture(params=[2_000_000, 50])
def small_buckets(request, monkeypatch):
    monkeypatch.setattr(C, "BUCKET", request.param)
    monkeypatch.setattr(C, "_HELD", 300)
    monkeypatch.setattr(C, "HOME", 100 if request.param == 50 else 8000)


def test_base_and_gain(spark, small_buckets):
    rows = docs()
    words = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    count = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(count.values()), len(count)
    expected = sorted((i if i is not None else -1, held(i), len(words(t)), sum(count[w] > 0 for w in words(t)), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)), 6)) for i, t in rows)
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double").repartition(3)
    got = C.scored(df, top_words=30, n_items=12, n_endings=10, n_classes=5).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def classes_of(model, words):
    items, top, rest, _, place = model.words.look_up(words)
    return model.classes.of(items, top, rest, place).tolist()


def test_probabilities_sum_to_one(spark):
    """Over all words of the vocabulary and one unseen word of each ending, after any class, the tokens' probabilities sum to one."""
    rows = [r for r in docs() if r[1]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = C.train(df, top_words=30, n_items=12, n_endings=10, n_classes=5)
    assert len(model.words.more) > 20
    count = Counter(w for _, t in rows for w in C.words_of(t))
    words = [*count, C.END]
    seen = [count[w] for w in count] + [len(rows)]
    mass = np.zeros(model.step.shape[0])
    for n, c in zip(seen, classes_of(model, words), strict=True):
        mass[c] += n + 0.1
    for item in range(model.words.n_items + 1, model.words.last + 1):
        mass[model.classes.item[item]] += 0.1
    for c in range(len(mass)):
        assert sum(10 ** (model.step[c, j] - model.total[j]) * mass[j] for j in range(len(mass)) if mass[j]) == pytest.approx(1)


def test_words_beyond_the_items_are_clustered_by_their_neighbours(spark):
    """Words of shared endings, too rare to be items, that stand in two kinds of places: classes follow the places, not the endings."""
    rng = random.Random(3)
    left, right = [f"l{i}xx" for i in range(20)], [f"r{i}xx" for i in range(20)]
    pick = lambda ws: rng.choice(ws[:3]) if rng.random() < 0.6 else rng.choice(ws)
    rows = [(i, " ".join(w for _ in range(8) for w in ("go", pick(left), "to", pick(right)))) for i in range(400)]
    model = C.train(spark.createDataFrame(rows, "doc_id long, text string"), top_words=10, n_items=8, n_endings=5, n_classes=5)
    assert len(model.words.more) > 25
    assert set(classes_of(model, [w.encode() for w in left])).isdisjoint(classes_of(model, [w.encode() for w in right]))
    few = C.train(spark.createDataFrame(rows, "doc_id long, text string"), top_words=10, n_items=2, n_endings=5, n_classes=4, most_words=1)
    assert len(few.words.more) == 0 and few.tokens == model.tokens


def test_score_against_the_model_by_hand(spark):
    rows = docs()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    learn = [(i, t) for i, t in rows if zlib.crc32(b"" if i is None else str(i).encode()) % 10]
    model = C.train(spark.createDataFrame(learn, "doc_id long, text string"), top_words=30, n_items=12, n_endings=10, n_classes=5)
    count = Counter(w for _, t in learn for w in [*C.words_of(t), C.END])
    expected = []
    for i, t in rows:
        words, before, score = [*C.words_of(t), C.END], int(model.classes.item[0]), 0.0
        for w, c in zip(words, classes_of(model, words), strict=True):
            score += model.step[before, c] + math.log10(count[w] + 0.1) - model.total[c]
            before = c
        expected.append((i if i is not None else -1, round(score, 6)))
    got = C.scored(df, top_words=30, n_items=12, n_endings=10, n_classes=5).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, round(r.score, 6)) for r in got) == sorted(expected)


def test_no_training_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert C.scored(empty).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = C.scored(spark.createDataFrame([(held, "a b a")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (4, 0, 0, 0.0) and r.score <= 0

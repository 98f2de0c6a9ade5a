import hashlib
import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from logloom.llm import suffix as S


def plain(docs, depth):
    seen, out = {}, {}
    for i, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - depth + 1):
            if seen.setdefault(b[p : p + depth], (i, p)) != (i, p):
                gone[p : p + depth] = [True] * depth
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(rest).hexdigest())
    return out


def documents(seed):
    rng = random.Random(seed)
    words = [f"{rng.choice('abcdéñ')}{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common = [text(rng.randint(20, 60)) for _ in range(6)]
    docs = []
    for i in range(90):
        parts = [rng.choice(common) if rng.random() < 0.4 else text(rng.randint(1, 50)) for _ in range(rng.randint(1, 5))]
        docs.append((i, " ".join(parts)))
    docs += [(200 + i, docs[i][1]) for i in range(8)]
    for i in range(20):
        x = list(docs[i % 3][1])
        x[rng.randrange(len(x))] = "#"
        docs.append((300 + i, "".join(x)))
    docs += [(400, None), (401, ""), (402, "short"), (403, "ab" * 300), (404, "b" * 500), (405, "ab" * 51), (406, "ü" * 200)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("depth", "gram", "large"), [(100, 32, 2048), (100, 32, 1), (40, 8, 3), (20, 20, 2)])
def test_against_all_strings(spark, depth, gram, large):
    docs = documents(depth + large)
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, key int").repartition(5)
    got = S.remove_repeats(df, depth, gram, large).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == plain(docs, depth)
    assert all(hashlib.sha256(r.data).hexdigest() == r.kept_sha256 for r in got)


def test_pieces(spark, monkeypatch):
    from functools import partial

    import numpy as np

    rng = random.Random(1)
    data = np.array([rng.choice(b"abc") for _ in range(5000)], np.uint8)
    whole = [tuple(x.tolist()) for x in next(S.anchors(data, S._Hashes()))]
    monkeypatch.setattr(S, "PIECE", 700)
    cut = [np.concatenate(x) for x in zip(*S.anchors(data, S._Hashes()), strict=True)]
    strings = lambda first, more: sorted(p for a, m in zip(first, more, strict=True) for p in range(a, a + m + 1))
    assert strings(whole[2], whole[4]) == strings(cut[2].tolist(), cut[4].tolist()) == list(range(4901))
    assert {(k, a + b) for k, a, b in zip(whole[0], whole[2], whole[3], strict=True)} == {(k, a + b) for k, a, b in zip(*(cut[i].tolist() for i in (0, 2, 3)), strict=True)}
    assert partial


def test_repeated_rows_and_nulls(spark):
    text = "word " * 3 + "".join(chr(97 + i * i % 26) for i in range(300))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed) for r in S.remove_repeats(df).collect())
    one = plain([(1, text)], 100)[1][1]
    assert got == [(-1, 0), (1, one), (1, one), (2, len(text))]


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_gram_of_all_documents_is_split(spark, monkeypatch):
    """All documents share a gram, each with other bytes around it, and groups of them share whole strings with it. The share of a split gram
    is so low that it goes to several tasks, and few strings are held, so that equal ones meet again after the shuffle."""
    rng = random.Random(7)
    middle = "".join(rng.choice("abcdefgh") for _ in range(60))
    side = lambda: "".join(rng.choice("stuvwxyz") for _ in range(60))
    sides = [side() for _ in range(12)]
    docs = [(i, (rng.choice(sides) if i % 3 else side()) + middle + (rng.choice(sides) if i % 2 else side())) for i in range(240)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    filed = pa.Table.from_batches([*S._file(df.select("doc_id", F.xxhash64("text").alias("mark"), "text").toArrow().to_batches(), 100, 32)])
    named = filed.filter(pc.equal(filed["until"], S.NAMED))
    assert pc.max(named["extent"]).as_py() > 100  # one gram holds more than a hundred extents of this batch
    for held in (1, 50, 100_000):
        monkeypatch.setattr(S, "STRINGS_HELD", held)
        got = S.remove_repeats(df, 100, 32, large=5).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == plain(docs, 100)

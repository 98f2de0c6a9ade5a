"""Rows without an id and texts that share one are judged one by one, by their own texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import decontaminate, simhash, suffix
from logloom.llm.shared import text_hashes

from .test_suffix import plain


@pytest.fixture
def near(monkeypatch):
    """Texts that are written fingerprints."""
    monkeypatch.setattr(simhash, "fingerprints", written)


def written(df, shingle=3, with_hashes=False):
    fp = F.col("text").cast("long").alias("fp")
    return df.select("doc_id", fp, *(text_hashes("text") if with_hashes else ()))


@pytest.mark.parametrize("between", [3, None])
def test_links_run_through_rows_without_an_id(spark, near, between):
    u, n, v = 0, 0b111, 0b111111  # n is near to both, which are apart
    df = spark.createDataFrame([(1, str(u)), (between, str(n)), (2, str(v)), (9, str(255 << 50))], "doc_id long, text string")
    got = {r.fingerprint: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert [got[f"{x:016x}"] for x in (u, n, v)] == [1, 1, 1] and got[f"{255 << 50:016x}"] == 9
    assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == [1, 9]


def test_texts_that_share_an_id_are_linked_only_if_alike(spark, near):
    far = (1 << 40) - 1
    df = spark.createDataFrame([(5, "0"), (5, str(far)), (7, str(far)), (8, "1")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.near_duplicates(df).collect())) == [(5, "0" * 16, 5), (5, f"{far:016x}", 5), (7, f"{far:016x}", 5), (8, f"{1:016x}", 5)]
    assert sorted(map(tuple, simhash.one_of_each(df).collect())) == [(5, "0"), (5, str(far))]


def test_one_of_each_without_ids(spark, near):
    far = 255 << 40
    df = spark.createDataFrame([(None, "0"), (None, "0"), (None, "1"), (4, str(far)), (None, str(far + 1)), (None, str(255 << 50))], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in simhash.one_of_each(df).collect())
    assert got in ([(0, x), (0, str(255 << 50)), (4, str(far))] for x in "01")


def text(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice("abcdefghijklmnop qrstuvwxyz") for _ in range(n))


@pytest.mark.parametrize("shared", [None, 7])
@pytest.mark.parametrize("large", [2048, 1])
def test_no_unique_byte_goes(spark, shared, large):
    passage = text(1, 150)
    first, second, third = text(2, 200) + f"1{passage}2" + text(3, 100) + f"3{passage}4" + text(4, 9), text(5, 900), text(6, 40) + f"5{passage}"
    df = spark.createDataFrame([(shared, first), (shared, second), (shared, third), (50, passage)], "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix.remove_repeats(df, large=large).collect()}
    assert got[(shared, 900)] == 0 and got[(50, 150)] == 150
    # of the two texts with the passage, that of the lesser hash keeps it once
    assert (got[(shared, len(first))], got[(shared, len(third))]) in ((150, 150), (300, 0))
    rest = {len(r.text) for r in suffix.without_repeats(df, large=large).collect()}
    assert 900 in rest and 0 in rest


def test_shared_ids_against_all_strings(spark):
    rng = random.Random(3)
    common = [text(i, 160) for i in range(4)]
    docs = [(rng.choice([None, 1, 2]), "".join(rng.choice(common) if rng.random() < 0.5 else text(rng.random(), 60) for _ in range(4))) for _ in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    order = {r.text: r.mark for r in df.select("text", *text_hashes("text", ("mark",))).collect()}
    ranked = sorted(set(docs), key=lambda d: (d[0] or 0, order[d[1]]))
    expected = plain(list(enumerate(t for _, t in ranked)), 100)
    want = sorted({(str(ranked[i][0]), *x) for i, x in expected.items()})
    assert sorted({(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(df).collect()}) == want


def test_contamination_is_judged_row_by_row(spark):
    item = " ".join(f"q{i}" for i in range(20))
    rows = [(None, "x " + item, 1), (None, "clean text", 2), (3, item, 3), (3, "also clean", 4), (None, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, item), (2, "other words here")], "item_id long, text string")
    assert sorted(r.item_id for r in decontaminate.clean(df, items).collect()) == [2, 4, 5]
    assert sorted(r.item_id for r in decontaminate.clean(df, items, block_bytes=10).collect()) == [2, 4, 5]


def test_intervals_of_documents_of_one_id():
    ids, marks = np.array([1, 1, 1, 2]), np.array([5, 5, 6, 5])
    got = suffix._joined(ids, marks, np.array([0, 10, 5, 0]), np.array([12, 20, 8, 3]))
    assert [x.tolist() for x in got] == [[1, 1, 2], [5, 6, 5], [0, 5, 0], [20, 8, 3]]

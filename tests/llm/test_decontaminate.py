import random

import numpy as np
import pytest

from logloom.llm import decontaminate as D


def plain_align(item, text):
    """Smith-Waterman cell by cell: (score, matches), the better by score and then by matches."""
    best = (0, 0)
    row = [(0, 0)] * (len(text) + 1)
    for a in item:
        new = [(0, 0)]
        for j, b in enumerate(text):
            s, m = row[j]
            options = [(s + 2, m + 1) if a == b else (s - 1, m), (row[j + 1][0] - 1, row[j + 1][1]), (new[j][0] - 1, new[j][1])]
            new.append(max(o if o[0] > 0 else (0, 0) for o in options))
        row = new
        best = max(best, max(row))
    return best


@pytest.mark.parametrize("seed", range(30))
def test_align(seed):
    rng = random.Random(seed)
    item, text = ([rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(2))
    assert D.align(np.array(item), np.array(text)) == plain_align(item, text)


def test_finds_copies_and_edits(spark):
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(500)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.randint(12, 50))) for i in range(30)]
    docs, planted = [], {}
    for i in range(200):
        doc = text(rng.randint(0, 120))
        if i % 4 == 0:
            item, ws = rng.choice(items)
            ws = list(ws)
            if i % 8 == 0:  # one word in ten differs
                for k in rng.sample(range(len(ws)), len(ws) // 10):
                    ws[k] = "changed"
            if i % 16 == 0:
                ws.insert(len(ws) // 2, "more")
            at = rng.randint(0, len(doc))
            doc = [*doc[:at], *(w.upper() + "," for w in ws), *doc[at:]]
            planted[i] = item
        elif i % 4 == 1:  # half an item is no copy
            doc = [*doc, *rng.choice(items)[1][:6]]
        docs.append((i, " ".join(doc)))
    docs += [(1000, None), (1001, ""), (1002, "tiny test"), (None, " ".join(items[0][1]))]
    rows = [(i, " ".join(w)) for i, w in items] + [(500, None), (501, ""), (502, "Tiny test!"), (None, "x y z")]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, item_id int")
    expected = {*planted.items(), (1002, 502), (None, 0)}
    for bytes_ in (8 << 20, 2000):
        got = D.contaminated(df, spark.createDataFrame(rows, "item_id long, text string"), block_bytes=bytes_).collect()
        assert {(r.doc_id, r.item_id) for r in got} == expected
    best = {(i, k): plain_align(D.words(t), D.words(x))[1] for i, t in docs for k, x in rows if (i, k) in expected}
    assert all(r.n_matched == best[r.doc_id, r.item_id] for r in got)


def test_item_in_very_many_texts(spark):
    item = " ".join(f"a{i}" for i in range(20))
    df = spark.createDataFrame([(i, f"start {item} end") for i in range(300)], "doc_id long, text string")
    got = D.contaminated(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == list(range(300))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.contaminated(docs, items).collect() == D.contaminated(docs, one).collect() == []
    assert D.contaminated(one.withColumnRenamed("item_id", "doc_id"), items).collect() == []

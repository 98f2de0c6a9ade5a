import random

import numpy as np

from logloom.llm import decontaminate as D


def edited(rng, item, n):
    ws = list(item)
    for k in rng.sample(range(len(ws)), n):
        ws[k] = f"other{rng.randrange(1000)}"
    return ws


def test_edited_copies_of_leaked_items(spark):
    """Copies at similarity 0.8 just so, of items that also stand in many other texts."""
    rng = random.Random(5)
    items = [(k, [f"w{rng.randrange(400)}" for _ in range(n)]) for k, n in enumerate((10, 15, 20, 30, 60))]
    docs, expected = [], set()
    for k, item in items:
        for copy in range(60):
            ws = item if copy < 20 else edited(rng, item, len(item) // 5)
            if copy >= 50:  # words put in between break all runs
                ws = [x for w in ws for x in (w, "between")] if copy < 55 else [x for i, w in enumerate(ws) for x in ((w, "between") if i % 2 else (w,))]
            around = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(80))]
            at = rng.randint(0, len(around))
            docs.append((len(docs), " ".join([*around[:at], *ws, *around[at:]])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = D.contaminated(df, spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")).collect()
    for i, text in docs:
        number = {w: n for n, w in enumerate(sorted({w.encode() for _, ws in items for w in ws}))}
        numbers = np.array([number.get(w, -1) for w in D.words(text)], np.int64)
        for k, item in items:
            matched = D.align(np.array([number[w.encode()] for w in item]), numbers)[1]
            if matched / len(item) >= 0.8:
                expected.add((i, k, matched))
    assert len(expected) > 250
    assert {(r.doc_id, r.item_id, r.n_matched) for r in got} == expected

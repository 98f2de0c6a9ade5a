import random
import re
from itertools import permutations

from logloom.llm import filteraudit as A
from logloom.llm.filteraudit_query import ORACLE_SQL, query

from .oracle import rows_of_frame, rows_of_sql

SF = "/root/testdata/sf0.001"
DOCS, LABELS = "doc_id long, text string, source string, n int, bad string, good int", "doc_id long, quality int, toxic int, source string"


def fails(doc, docs):
    i, text = doc[0], doc[1] or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)),
        "E": i is not None and any(d[0] is not None and d[0] < i and (d[1] or "") == text for d in docs),
    }


def brute_force(docs, labels):
    good, bad = {x[0] for x in labels if x[1] == 1}, {x[0] for x in labels if x[2] == 1}
    rows, total = [], {}
    judged = [(d[2] or "", d[0], fails(d, docs)) for d in docs]
    for part in {p for p, _, _ in judged}:
        mine = [(i, f) for p, i, f in judged if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                here = [(i, f) for i, f in left if f[x]]
                left = [(i, f) for i, f in left if not f[x]]
                total[part, x] = total.get((part, x), 0) + len(here)
                only = sum(f[x] and sum(f.values()) == 1 for _, f in mine)
                rows.append([part, order, step, len(left), len(here), sum(f[x] for _, f in mine) - len(here), only, sum(i is not None and i in good for i, _ in here), sum(i is not None and i in bad for i, _ in here)])
    return sorted((*r, total[r[0], r[1][r[2] - 1]]) for r in rows)


def got(spark, docs, labels):
    found = A.interactions(spark.createDataFrame([(*d, 1, "x", 2) for d in docs], DOCS), spark.createDataFrame([(*x, "y") for x in labels], LABELS))
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sorted(tuple(r) for r in found.collect())


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = [*(f"w{i}" for i in range(80)), "LOUD", "Ünïque", "#tag", "a|b", " "]
    texts = [None, "", " \t\n", "# $", "ABC"] + [rng.choice([" ", "\n", "\x0b "]).join(rng.choices(words[: rng.choice((10, 60, 85))], k=rng.choice((5, 49, 50, 51, 70)))) for _ in range(25)]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["a", "b", None, ""])) for _ in range(120)]
    docs += docs[:10] + [(200 + i, texts[7], "hot") for i in range(60)] + [(999, "x " * 4000, "long")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 60, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (10_000, 1, 1)]
    assert got(spark, docs, labels) == brute_force(docs, labels)


def test_a_part_that_nothing_fails(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = got(spark, [(1, text, "s")], [(1, 1, 0)])
    assert len(rows) == 600 and all(r[3:] == (1, 0, 0, 0, 0, 0, 0) for r in rows)


def test_empty_tables(spark):
    assert got(spark, [], []) == []
    assert len(got(spark, [(1, "x", "s")], [])) == 600


def test_query_against_sql(spark):
    assert rows_of_frame(query(spark, SF)) == rows_of_sql(ORACLE_SQL, SF)

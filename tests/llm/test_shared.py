import random

import pytest

from logloom.llm import shared


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(30)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_no_edges(spark):
    assert shared.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_held_out(spark):
    import zlib

    rows = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long")
    got = {r.doc_id: r.h for r in rows.select("doc_id", shared.held_out("doc_id", 5, 0).alias("h")).collect()}
    assert got == {i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0 for i in [*range(50), None]}

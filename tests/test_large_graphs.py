from logloom.operators import graph
from logloom.plans import state_queries as Q


def live(n):
    """(node, var) by brute force over the customers 0 to n - 1."""
    seen = {(c, c % 4) for c in range(0, n, 5)}
    todo = list(seen)
    while todo:
        node, var = todo.pop()
        src = (node - 1) // 2
        if node % 2 and (src, var) not in seen and not (src % 6 == 1 and src % 4 == var):
            seen.add((src, var))
            todo.append((src, var))
    return seen


def test_liveness_beyond_small_ids(spark, tmp_path):
    spark.range(4000).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    assert {tuple(r) for r in Q.liveness_fixpoint(spark, str(tmp_path)).collect()} == live(4000)


def test_rounds_are_written_together(spark):
    """A chain takes a round for each link; the parts of its rounds are written together, and nodes keep their first depth."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(11)] + [(4, 2), (9, 0)], "src long, dst long")
    found = graph.reachable(edges, spark.createDataFrame([(0,)], "node long"))
    assert sorted(map(tuple, found.collect())) == [(i, i) for i in range(12)]
    live_at = graph.live_in(edges, spark.createDataFrame([(11, "r1")], "node long, var string"), spark.createDataFrame([(1, "r1")], "node long, var string"))
    assert sorted(r.node for r in live_at.collect()) == list(range(2, 12))  # 9 -> 0 -> 1 ends at the definition

    parts = []
    for i in range(2 * graph.PARTS + 3):
        parts = graph._with_part(parts, spark.range(i, i + 1))
    assert [rank for rank, _ in parts] == [1, 1, 0, 0, 0]
    assert sorted(r.id for r in graph._whole(parts).collect()) == list(range(2 * graph.PARTS + 3))

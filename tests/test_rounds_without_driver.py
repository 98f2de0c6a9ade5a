"""Rounds of fixpoints take nothing through the driver, however small a frontier is."""

from __future__ import annotations

import pytest
from logloom.operators import graph


@pytest.mark.parametrize("which", ["reachable", "live_in", "chain_places"])
def test_no_round_is_broadcast(spark, monkeypatch, which):
    plans, cut = [], graph._cut

    def seen(df):
        done = cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())  # as it ran
        return done

    monkeypatch.setattr(graph, "_cut", seen)
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src long, dst long")
    nodes = spark.createDataFrame([(0,)], "node long")
    if which == "reachable":
        assert sorted(map(tuple, graph.reachable(edges, nodes).collect())) == [(0, 0), (1, 1), (2, 2)]
    elif which == "live_in":
        var = nodes.selectExpr("node", "7 AS var")
        assert sorted(map(tuple, graph.live_in(edges, var, var.where("node > 0")).collect())) == [(0, 7), (1, 7), (2, 7)]
    else:
        links = spark.createDataFrame([("a", 0, 1), ("a", 1, 2)], "log string, node long, next long")
        assert {r.place for r in graph.chain_places(links, ["log"]).collect()} == {1, 2}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)

"""Rounds over calls that are dealt out by object shuffle nothing, and good objects cost no second look at all code."""

from logloom.operators import linking

from .test_linking import NAMES, built, call, checked, other, tables


def chain(n):
    """A function that calls the next one, n times over, from an entry that calls the first."""
    text = [x for k in range(n) for x in (call(1) if k + 1 < n else other(k), other(k))]
    return built(NAMES, {1: text, 2: [call(-1), other(7)]}, [(1, 2 * k, 2) for k in range(n)], [(2, 0, 0, None)])


def test_rounds_shuffle_nothing(spark, monkeypatch):
    plans, cut = [], linking.cut
    monkeypatch.setattr(linking, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    before = dict(spark.conf.getAll)
    checked(spark, {f"o{k}": chain(k) for k in range(1, 5)})
    assert len(plans) > 8 and not any("Exchange" in p for p in plans)
    assert dict(spark.conf.getAll) == before


def test_code_is_read_again_for_objects_with_problems_only(spark):
    plan = lambda objects: linking.loaded(*tables(spark, objects))._jdf.queryExecution().optimizedPlan().toString()
    recursive = built(NAMES, {1: [call(-1), other(1)], 2: [call(-1)]}, [(1, 0, 2)], [(2, 0, 0, None)])
    assert plan({"a": chain(3)}).count("Join") < plan({"a": chain(3), "b": recursive}).count("Join")
    assert checked(spark, {"a": chain(3), "b": recursive})["b", 2][0][2] == "recursion"

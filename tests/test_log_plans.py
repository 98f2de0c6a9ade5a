"""How often the lines of logs are shuffled and sorted, and what the fewer steps must still tell apart."""

from __future__ import annotations

import re

import duckdb
import pytest
from logloom.operators import logs
from logloom.plans import projections as P

from .sql_twins import TABLES


def _frame(spark, **texts):
    return spark.createDataFrame([(name, k, line) for name, text in texts.items() for k, line in enumerate(text.split("\n"), 1)], "log_id string, line_no int, line string")


def _steps(df, name: str) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(rf"(?m)^[\s:+-]*(?:\*\(\d+\) )?{name}\b", plan))


def test_blocks_of_one_log(spark):
    begin, end = "x -- BEGIN PROG LOAD LOG --", "x -- END PROG LOAD LOG --"
    found = _frame(
        spark, both=f"{begin} {end[2:]}\ninvalid a\n{begin}\nb\n{end}", error=f"{begin}\ninvalid a\n{begin}\nc\n{end}\nd\n{begin}\ne", last=f"{begin}\na\n{end}\ninvalid b\n{begin}\nc\n{end}",
        late="R1 !read_ok\n0: (95) exit", between="a\n0: (95) exit\nR1 !read_ok\nfunc#1 @7",
    )
    kept = {}
    for r in logs.region(found).orderBy("log_id", "line_no").collect():
        kept.setdefault(r.log_id, []).append((r.line_no, r.line))
    assert kept["both"] == [(1, "b")] and kept["last"] == [(1, "c")]
    assert kept["error"] == [(1, "invalid a"), (2, begin), (3, "c")]
    assert kept["late"] == [(1, "R1 !read_ok"), (2, "0: (95) exit")] and kept["between"] == [(1, "0: (95) exit"), (2, "R1 !read_ok")]


def test_a_region_is_sorted_once(spark):
    found = logs.region(_frame(spark, a="invalid a"))
    assert (_steps(found, "Sort"), _steps(found, "Exchange")) == (1, 1)


def test_terminals_are_sorted_once(spark):
    found = logs.terminals(_frame(spark, a="invalid a"))
    assert (_steps(found, "Sort"), _steps(found, "Exchange")) == (1, 1)


def test_items_are_read_once(spark):
    plan = P.logs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1


@pytest.mark.parametrize("twice", [False, True])
def test_lines_equal_their_sql(spark, tmp_path, twice):
    """Also where an order stands twice, is missing, or its items have no key."""
    sf, c = "/root/testdata/sf0.001", duckdb.connect()
    for t in TABLES:
        if not twice or t not in ("orders", "lineitem"):
            (tmp_path / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    if twice:
        c.sql(f"SELECT * FROM '{sf}/orders.parquet' WHERE o_orderkey % 5 > 0 UNION ALL SELECT * FROM '{sf}/orders.parquet' WHERE o_orderkey % 3 = 0").write_parquet(str(tmp_path / "orders.parquet"))
        c.sql(f"SELECT * REPLACE (CASE WHEN l_orderkey % 7 > 0 THEN l_orderkey END AS l_orderkey) FROM '{sf}/lineitem.parquet'").write_parquet(str(tmp_path / "lineitem.parquet"))
    for t in ("orders", "lineitem"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    wanted = c.sql(P.sql(P.INSTRUCTION_LINES, P.MESSAGES, P.LOGS, query="SELECT * FROM logs")).fetchall()
    found = [tuple(r) for r in P.logs(spark, str(tmp_path)).collect()]
    key = lambda r: (r[0] or 0, r[1], r[2])
    assert sorted(found, key=key) == sorted(wanted, key=key)

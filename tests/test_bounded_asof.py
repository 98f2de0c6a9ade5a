"""Look-ups by line and pc, and in a frame, against a scan of all states."""

import random
import time

import pytest
from pyspark.sql import functions as F

from logloom.operators import asof, sites

STATES = "log_id long, log_line long, pc long, frame int, reg int, state struct<reg_type:string,source_frame:int>"
POINTS = "log_id long, point_id string, p_line long, p_pc long, p_from long, reg int"


def wanted(states, point, inclusive):
    log, _, line, pc, start, reg = point
    inside = [s for s in states if s[0] == log and start <= s[1] and (s[1] <= line if inclusive else s[1] < line) and s[2] <= pc]
    if not inside:
        return None
    frame = max(inside, key=lambda s: s[1])[3]
    mine = [s for s in inside if s[3] == frame and s[4] == reg]
    return max((s[1] for s in mine), default=None)


@pytest.mark.parametrize("inclusive", [False, True])
def test_registers_before(spark, inclusive):
    rng = random.Random(4 + inclusive)
    states = [(log, line, rng.choice((rng.randint(0, 40), rng.randint(0, 5000), (1 << 20) - 1)), rng.randint(0, 2), rng.randint(0, 3), (f"t{line}", rng.choice((None, 7)))) for log in range(6) for line in rng.sample(range(1, 200), 90)]
    states += [(9, 5, 3, 0, 1, ("only", None))]
    points = [(rng.randint(0, 7), f"p{k}", rng.randint(0, 210), rng.choice((rng.randint(0, 50), rng.randint(0, 6000), (1 << 20) - 1)), rng.randint(1, 150), rng.choice((0, 1, 2, 3, 10))) for k in range(300)] + [(9, "a", 5, 3, 5, 1), (9, "b", 6, 2, 1, 1), (9, "c", 6, 3, 6, 1), (9, "d", 6, 3, 5, None)]
    long = spark.createDataFrame(states, STATES)
    found = long.select("log_id", "log_line", "pc", "frame")
    got = sites.registers_before(spark.createDataFrame(points, POINTS), found, long, inclusive).collect()
    assert len(got) == len(points)
    at = {(s[0], s[1]): s for s in states}
    for r in got:
        line = wanted(states, (r.log_id, r.point_id, r.p_line, r.p_pc, r.p_from, r.reg), inclusive)
        if line is None:
            assert r.seen is None
        else:
            s = at[r.log_id, line]
            assert (r.seen.log_line, r.seen.state.reg_type, r.seen.frame, r.seen.source_frame) == (line, s[5][0], s[3], s[3] if s[5][1] is None else s[5][1])


def test_narrow_pcs_and_repeated_lines_of_points(spark):
    rng = random.Random(8)
    states = [(1, line, rng.randint(0, 63)) for line in range(100)]
    points = [(1, k, line, rng.randint(0, 63)) for k, line in enumerate([50] * 40 + [0, 1, 99, 100])]
    s = spark.createDataFrame(states, "log_id long, log_line long, pc long")
    got = asof.latest_bounded(spark.createDataFrame(points, "log_id long, point_id long, log_line long, pc long"), s, ["log_id"], F.col("pc"), bits=6).collect()
    for r in got:
        below = [x for x in states if x[1] < r.log_line and x[2] <= r.pc]
        assert r.value == (max(below, key=lambda x: x[1])[2] if below else None)


def test_one_long_log(spark):
    """A log of 100,000 states and 50,000 points: the product would be five billion rows."""
    n = 100_000
    long = spark.range(n).select(F.lit(1).cast("long").alias("log_id"), (F.col("id") + 1).alias("log_line"), (F.col("id") * 7919 % 4096).alias("pc"), (F.col("id") % 2).cast("int").alias("frame"), (F.col("id") % 11).cast("int").alias("reg"), F.struct(F.lit("scalar").alias("reg_type"), F.lit(None).cast("int").alias("source_frame")).alias("state"))
    points = spark.range(n // 2).select(F.lit(1).cast("long").alias("log_id"), F.col("id").cast("string").alias("point_id"), (F.col("id") * 2 + 1).alias("p_line"), (F.col("id") * 31 % 4096).alias("p_pc"), F.lit(1).cast("long").alias("p_from"), (F.col("id") % 11).cast("int").alias("reg"))
    began = time.time()
    seen = sites.registers_before(points, long.select("log_id", "log_line", "pc", "frame"), long).agg(F.count("seen").alias("n"), F.max("seen.log_line").alias("most")).first()
    assert seen.n > 40_000 and seen.most <= n and time.time() - began < 240

"""Steps of one analysis that do not wait for one another, and their results side by side."""

import threading

import pytest
from pyspark.sql import functions as F

from logloom.functions import instructions as I
from logloom.functions import states as S
from logloom.operators import diagnose, signals
from logloom.operators.storage import shared_folder, side_by_side, together


def test_steps_are_in_work_at_the_same_time(spark):
    met = threading.Barrier(3, timeout=60)

    def step(n):
        met.wait()  # a step that waited for another one's end would never be met
        return spark.range(n).count()

    assert together(spark, *(lambda n=n: step(n) for n in (3, 1, 2))) == [3, 1, 2]


def test_a_step_that_fails_fails_all(spark):
    with pytest.raises(ZeroDivisionError):
        together(spark, lambda: 1, lambda: 1 // 0)


def test_side_by_side_is_a_row_of_joins(spark):
    a = spark.createDataFrame([(1, True, None), (2, None, "x")], "log_id int, a boolean, b string")
    b = spark.createDataFrame([(2, 7)], "log_id int, c int").withColumn("s", F.struct("c"))
    c = spark.createDataFrame([(3, "y")], "log_id int, d string").withColumn("m", F.create_map("d", F.lit(1)))
    joined = a.join(b, "log_id", "full").join(c, "log_id", "full")
    key = lambda df: sorted(df.select(joined.columns).collect(), key=lambda r: r.log_id)
    assert key(side_by_side([a, b, c], "log_id")) == key(joined)


def test_entries_of_callbacks_come_from_the_registers(spark, monkeypatch):
    """No state is parsed again for them: a plan with that parser took 26 s to make."""

    state = S.register_state(F.lit("1"), F.lit(False)).alias("state")
    found = spark.createDataFrame([], "log_id int, log_line int, pc int, from_pc int, frame int, kind string, tokens array<string>")
    long = found.select("*", F.lit(2).alias("reg"), state)

    def parsed(tokens):
        raise AssertionError("states are parsed again")

    monkeypatch.setattr(S, "registers", parsed)
    rows = spark.createDataFrame([], "log_id int, line_no int, pc int, tail string, frame int")
    ctx = spark.createDataFrame([], "log_id int, call struct<line:int,pc:int,tail:string,fragment:int>")
    origin = spark.createDataFrame([], "log_id int, origin_line int, slot struct<frame:int,off:int>")
    assert signals.callback_writes(origin, ctx, rows, found, long).isEmpty()


def test_lines_are_made_once(spark, monkeypatch):
    """All steps of `explained` read a table of the lines, not what the lines are made of."""

    class Seen(Exception):
        pass

    def prepared(all_lines, classified, full_lines=None):
        raise Seen(all_lines, classified)

    monkeypatch.setattr(signals, "prepared", prepared)
    lines = spark.createDataFrame([(1, 1, "0: (95) exit"), (1, 2, "R0 !read_ok")], "log_id int, line_no int, line string")
    with pytest.raises(Seen) as seen:
        diagnose.explained(lines)
    tables = shared_folder(spark).rstrip("/").split("/")[-1] + "/tables/"
    for df in seen.value.args:
        assert df.inputFiles() and all(tables in f for f in df.inputFiles())
    assert sorted(map(tuple, seen.value.args[0].collect())) == sorted(map(tuple, lines.collect()))


def test_logs_are_joined_by_shuffle(spark, monkeypatch):
    """Nothing with a row for each log goes through the driver: steps of `explained` join by shuffle, in a session of their own."""

    class Seen(Exception):
        pass

    def prepared(all_lines, classified, full_lines=None):
        raise Seen(all_lines, full_lines)

    monkeypatch.setattr(signals, "prepared", prepared)
    lines = spark.createDataFrame([(1, 1, "0: (95) exit"), (1, 2, "R0 !read_ok")], "log_id int, line_no int, line string")
    with pytest.raises(Seen) as seen:
        diagnose.explained(lines, lines)
    for rows in seen.value.args:
        joined = rows.join(rows.groupBy("log_id").count(), "log_id")
        assert len(joined.collect()) == 2 and "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
        assert rows.sparkSession.conf.get("spark.sql.session.timeZone") == "UTC" and rows.sparkSession.conf.get("spark.sql.shuffle.partitions") == "4"
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"


def test_only_lines_with_a_call_are_searched_for_its_target(spark):
    tails = ["(85) call bpf_loop#181", "(85) call pc+3", "(b7) r1 = 0", "recall x", "call", "(85) recall call  f", None]
    rows = spark.createDataFrame([(t,) for t in tails], "tail string").select(I.call_target(F.col("tail")).alias("target"))
    assert [r.target for r in rows.collect()] == ["bpf_loop", "pc+3", None, None, None, "f", None]
    assert "contains" in rows._jdf.queryExecution().optimizedPlan().toString().lower()

"""States of texts that are parsed once and looked up, against the parser itself; and the expressions of brackets, at any depth."""

import re

import pytest
from pyspark.sql import functions as F

from logloom.functions import states as S
from logloom.operators import cfg, states

TEXTS = ["7", "Pfp-8", "ctx()", "scalar(umax=255,var_off=(0x0; 0xff))", "scalar(map=a(b(c(d))),id=4)", "fp[1]-16", "inv", "", None]


@pytest.mark.parametrize("few", [1 << 16, 0])  # the states are sent to all tasks, or shuffled
def test_each_text_is_parsed_once(spark, monkeypatch, few):
    monkeypatch.setattr(states, "FEW_TEXTS", few)
    parsed = []
    monkeypatch.setattr(states, "with_stages", lambda df, *a, f=states.with_stages: (parsed.append(df), f(df, *a))[1])
    rows = [(k, t, k % 3 == 0, t) for k, t in enumerate(TEXTS * 40)]
    table = spark.createDataFrame(rows, "k int, text string, narrow boolean, slot string")
    found = states.with_states(table, {"text": "narrow", "slot": None}).select("k", "text_state", "slot_state")
    of = lambda c, n: F.when(F.col(c).isNotNull(), S.register_state(F.col(c), n))
    alone = table.select("k", of("text", F.col("narrow")).alias("text_state"), of("slot", F.lit(False)).alias("slot_state"))
    assert sorted(found.collect()) == sorted(alone.collect())
    assert [p.count() for p in parsed] == [len({(t, n) for _, t, n, _ in rows if t is not None}), 8]


def nested(k):
    return "a(" * k + "x y" + ")" * k


def test_brackets_of_any_depth(spark):
    lines = [f"0: R1=t{nested(k)} R2=7 fp-8={nested(k)}" for k in range(13)] + ["0: R1=a(b R2=7", "0: R1=a) R2=7) R3=8", f"0: (b7) r1 = {nested(9)} ; R1_w={nested(3)}", f"0: (b7) r1 = {nested(2)} ; R1_w={nested(8)} R2=1"]
    rows = spark.createDataFrame([(0, k, x) for k, x in enumerate(lines)], "log_id int, line_no int, line string")
    found = {r.log_line: r.tokens for r in states.states(rows).collect()}
    for k in range(13):
        assert found[k] == ([f"R1=t{nested(k)}", "R2=7", f"fp-8={nested(k)}"] if k else ["R1=tx", "y", "R2=7", "fp-8=x", "y"])
    assert found[15] == [f"R1_w={nested(3)}"] and found[16] == [f"R1_w={nested(8)}", "R2=1"]
    scan = spark.createDataFrame([(t,) for t in lines], "t string").select(F.filter(F.transform(S.top_level(F.col("t"), r"\s+"), lambda x: F.regexp_replace(x, r"^\)+", "")), lambda x: x != ""), S.top_level_tokens(F.col("t"))).collect()
    assert all(a == b for a, b in scan)
    # eight deep is no business of the scan
    assert re.search(r"\(\?:\[\^\(\)\]\+\+", S.SHALLOW) and spark.range(1).select(F.lit(nested(8)).rlike(S.SHALLOW), F.lit(nested(9)).rlike(S.SHALLOW)).first() == (True, False)


def test_visits_with_the_same_stack_are_looked_at_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(states, "once_for_each", lambda rows, keys, found, f=states.once_for_each: f(rows, keys, lambda some: (seen.append((keys, some.count())), found(some))[1]))
    lines = [(k // 4, k % 4, f"{k % 2}: R2=fp-8 R3=scalar(id={k}) fp-8={k % 2} fp-16=scalar(id={k})") for k in range(40)]
    found = states.states(spark.createDataFrame(lines, "log_id int, line_no int, line string")).withColumnRenamed("log_id", "program")
    asked = found.select("program", "pc").distinct().select("program", "pc", F.lit(2).alias("reg"), F.lit(4).alias("width"))
    rows = cfg.known_stack_bytes(found, asked).collect()
    assert sorted((r.program, r.pc, r.bytes) for r in rows) == [(p, pc, f"0{pc}000000") for p in range(10) for pc in (0, 1)]
    # one pointer, and of the slots only those that are asked for
    assert seen == [(["_pointer", "_narrow"], 1), (["_start", "width", "_near"], 2)]

from pyspark.sql import functions as F

from logloom.operators import asof, audit, diagnose, graph, intervals, logs, states


def frame(spark, text):
    return logs.lines(spark.createDataFrame([("a", text)], "log_id string, text string"))


LOG = """libbpf: load
-- BEGIN PROG LOAD LOG --
func#0 @0
0: R1=ctx() R10=fp0
; int x = data[0]; @ prog.c:17
0: (61) r2 = *(u32 *)(r1 +76)      ; R2_w=pkt(r=0)
1: (71) r0 = *(u8 *)(r2 +0)
invalid access to packet, off=0 size=1, R2(id=0,off=0,r=0)
R2 offset is outside of the packet
processed 2 insns
-- END PROG LOAD LOG --
"""


def test_diagnostic_of_a_log(spark):
    region = logs.region(frame(spark, LOG))
    assert region.count() == 8
    r = diagnose.diagnostics(region).first()
    assert (r.error_id, r.obligation, r.pc, r.register, r.reg_type, r.state_line) == ("E001", "PacketBounds", 1, 2, "pkt", 4)
    assert r.message == "invalid access to packet, off=0 size=1, R2(id=0,off=0,r=0); R2 offset is outside of the packet"
    assert r.text.startswith("error[E001]: invalid access to packet") and "--> instruction 1" in r.text
    t = logs.terminals(region).first()
    assert (t.line_no, t.source.path, t.source.line) == (6, "prog.c", 17)


def test_region_choices(spark):
    two = "-- BEGIN PROG LOAD LOG --\n0: (95) exit\ninvalid a\n-- END PROG LOAD LOG --\n-- BEGIN PROG LOAD LOG --\n1: (95) exit\n-- END PROG LOAD LOG --\n"
    assert [r.line for r in logs.region(frame(spark, two)).orderBy("line_no").collect()] == ["0: (95) exit", "invalid a"]
    plain = "noise\n3: (95) exit\nR1 !read_ok\nprocessed 1 insns\n"
    assert [r.line for r in logs.region(frame(spark, plain)).orderBy("line_no").collect()] == ["3: (95) exit", "R1 !read_ok"]
    assert logs.region(frame(spark, "nothing\nhere")).count() == 2


def test_lines_drop_controls_and_last_empty_line(spark):
    got = [(r.line_no, r.line) for r in frame(spark, "::group::x\n a\r\n\n b\n").orderBy("line_no").collect()]
    assert got == [(1, "a"), (2, ""), (3, "b")]


def test_malformed_state(spark):
    rows = frame(spark, "3: R1=ctx()\n4: Rx\nfrom 1: R\n")
    assert states.malformed_logs(rows).count() == 1 and states.states(rows).count() >= 1


def test_latest_and_depth(spark):
    s = spark.createDataFrame([(1, 1, "a"), (1, 5, "b"), (2, 3, "c")], "k int, t int, v string")
    p = spark.createDataFrame([(1, 1), (1, 5), (1, 9), (2, 1)], "k int, t int")
    before = {(r.k, r.t): r.value for r in asof.latest(p, s, ["k"], "t", F.col("v")).collect()}
    at = {(r.k, r.t): r.value for r in asof.latest(p, s, ["k"], "t", F.col("v"), inclusive=True).collect()}
    assert before == {(1, 1): None, (1, 5): "a", (1, 9): "b", (2, 1): None} and at == {(1, 1): "a", (1, 5): "b", (1, 9): "b", (2, 1): None}
    steps = [-1, 1, 1, -1, -1, -1, 1]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(steps)], "k int, i int, x int")
    depth, expected = 0, []
    for x in steps:
        depth = max(0, depth + x)
        expected.append(depth)
    assert [r.depth for r in asof.floored_depth(df, F.col("x"), ["k"], ["i"]).orderBy("i").collect()] == expected


def test_intervals(spark):
    a = spark.createDataFrame([(1, 0, -16, -4)], "access_id int, k int, a_start long, a_end long")
    s = spark.createDataFrame([(0, 1, -16, -8), (0, 2, -8, 0), (0, 2, -12, -8), (0, 3, -4, 0)], "k int, state_id int, s_start long, s_end long")
    got = {(r.state_id, r.s_start) for r in intervals.newest_overlaps(a, s, ["k"]).collect()}
    assert got == {(2, -8), (2, -12)}
    p = spark.createDataFrame([(0, -16, 16, -16, -8), (0, -16, 16, -9, -6), (0, -16, 16, -4, 0), (1, 0, 8, 2, 4)], "k int, start long, size long, s_start long, s_end long")
    assert {r.k: r.prefix for r in intervals.initialized_prefix(p, ["k"], "start", "size").collect()} == {0: 10, 1: 0}


def test_graph(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (5, 6)], "src int, dst int")
    assert {r.node: r.depth for r in graph.reachable(e, spark.createDataFrame([(0,)], "node int")).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}
    uses, defs = spark.createDataFrame([(3, "x"), (2, "y")], "node int, var string"), spark.createDataFrame([(1, "x")], "node int, var string")
    assert {tuple(r) for r in graph.live_in(e, uses, defs).collect()} == {(3, "x"), (2, "x"), (2, "y"), (1, "y"), (0, "y")}


def test_audits(spark):
    rows = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "k int, v string")
    assert [tuple(r) for r in audit.duplicates(rows, ["k"]).collect()] == [(1, 2)]
    assert sorted(tuple(r) for r in audit.violations(rows, "k", {"v": F.col("v") == "a"}).collect()) == [(1, "v"), (2, "v")]
    left, right = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k int, v string"), spark.createDataFrame([(1, None), (2, "z"), (4, "y")], "k int, v string")
    assert sorted(tuple(r) for r in audit.difference(left, right, ["k"], ["v"]).collect()) == [(2, "different"), (3, "missing"), (4, "extra")]

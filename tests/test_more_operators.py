"""Operators over whole logs, programs and cases, against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from logloom.functions import bytecode as B
from logloom.functions import evaluation as V
from logloom.functions import sources as T
from logloom.operators import cfg, corpus, harness, loader, logs, sites, states, success


def ids(df, column="log_id"):
    return sorted(r[column] for r in df.collect())


@pytest.fixture(scope="module")
def accepted(spark):
    a = [
        "0: R1=ctx() R10=fp0", "1: (85) call bpf_ringbuf_reserve#131 ; R0_w=ringbuf_mem(ref_obj_id=2,sz=4)", "2: (b7) r2 = 7 ; R2_w=7", "3: (63) *(u32 *)(r6 + 0) = r2 ; R2=7 R6=ringbuf_mem(ref_obj_id=2,sz=4)",
        "4: (bf) r1 = r6 ; R1_w=ringbuf_mem(ref_obj_id=2,sz=4)", "5: (85) call bpf_ringbuf_submit#132", "from 2 to 9: R1=ringbuf_mem(ref_obj_id=4,sz=4)", "9: (85) call bpf_ringbuf_submit#132",
    ]
    b = ["0: R1=ctx()", "1: R1=ringbuf_mem(ref_obj_id=2,sz=4) R2=0xb", "2: (63) *(u32 *)(r1 + 0) = r2 ; R1=ringbuf_mem(ref_obj_id=2,sz=4) R2=0xb", "3: (85) call bpf_ringbuf_submit#132", "4: R2=14", "5: (85) call bpf_xdp_adjust_head#44"]
    c = [
        "0: R1=ctx() R3=map_value(ks=4,vs=8)", "1: (61) r2 = *(u32 *)(r3 +4) ; R3=scalar()", "2: (63) *(u32 *)(r3 +4) = r2", "3: (85) call bpf_skb_change_proto#31", "4: (61) r5 = x ; R5_w=pkt(off=8,r=20)", "5: (6b) *(u16 *)(r5 + 4) = r2 ; R2=8",
        "6: (67) r7 <<= 2 ; R7=scalar()", "7: R5=pkt(off=0,umax=60,r=2)", "8: (69) r1 = *(u16 *)(r5 + 2)",
    ]
    rows = [(n, k, line) for n, text in (("a", a), ("b", b), ("c", c)) for k, line in enumerate(text, 1)]
    return spark.createDataFrame(rows, "log_id string, line_no int, line string")


def test_ring_buffers(accepted):
    assert {r.log_id: r.refs for r in success.submitted_refs(accepted).collect()} == {"a": ["2", "4"], "b": ["2"]}
    assert {r.log_id: r.refs for r in success.refs_with_value(accepted, 7).collect()} == {"a": ["2"]} and ids(success.refs_with_value(accepted, 11)) == ["b"]
    assert {r.log_id: r.passed for r in success.written_before(accepted).collect()} == {"a": False, "b": True}
    assert ids(success.submitted_with_value(accepted, (7,))) == ["a"] and ids(success.submitted_with_value(accepted, (7, 11))) == ["a", "b"]
    assert ids(success.distinct_submissions(accepted)) == ["a"]


def test_registers_at_calls(accepted):
    assert {r.log_id: r.passed for r in success.adjusts_head_by(accepted).collect()} == {"b": True}
    assert {r.log_id: r.passed for r in success.calls_use_value(accepted, "call bpf_xdp_adjust_head#44", "2", 15).collect()} == {"b": False}
    assert ids(success.reachable_with_value(accepted, "call bpf_ringbuf_submit#132", "2", 7)) == ["a"]


def test_pointers(accepted):
    assert ids(success.loads_map_value(accepted, 4)) == ["c"] and ids(success.loads_map_value(accepted, 0)) == []
    assert ids(success.stores_map_value(accepted, 4)) == []
    assert ids(success.stores_proto_after_change(accepted)) == ["c"] and ids(success.loads_behind_variable_header(accepted)) == ["c"]
    text = accepted.groupBy("log_id").agg(F.array_join(F.collect_list("line"), "\n").alias("text"))
    got = {(r.log_id, r.name): r.passed for r in success.checks(text, ("adjust_head",), {"map": success.loads_map_value(accepted, 4)}).collect()}
    assert got == {("a", "adjust_head"): False, ("b", "adjust_head"): True, ("c", "adjust_head"): False, ("a", "map"): False, ("b", "map"): False, ("c", "map"): True}


def test_normalized_output(spark):
    df = spark.createDataFrame([("/a/b.c in /w: fd=12 0xffff8881 /tmp/x-bench-Ab1/q verification time 88 usec", "/a/b.c", "/w", "/o", "/p")], "t string, s string, w string, o string, p string")
    assert df.select(success.normalized_output(*(F.col(c) for c in "tswop")).alias("x")).first().x == "buggy.bpf.c in <work-dir>: fd=0 0xffff000000000000 <work-dir>/q verification time 0 usec"


def test_programs(spark):
    word = lambda code, dst=0, src=0, off=0, imm=0: bytes([code, dst | src << 4]) + off.to_bytes(2, "little", signed=True) + imm.to_bytes(4, "little", signed=True)
    code = word(0x18, 1, 1, 0, 5) + word(0x18, 0, 0, 0, 9) + word(0x15, 1, 0, 2) + word(0x85, 0, 1, 0, 2) + word(0x05, 0, 0, -3) + word(0x95) + word(0xB7, 0, 0, 0, -1) + word(0x95)
    rows = cfg.instructions(spark.createDataFrame([("p", code)], "program string, code binary")).cache()
    assert [(r.pc, r.insn.code, r.insn.imm) for r in rows.orderBy("pc").collect()] == [(0, 0x18, 5), (2, 0x15, 0), (3, 0x85, 2), (4, 5, 0), (5, 0x95, 0), (6, 0xB7, -1), (7, 0x95, 0)]
    assert rows.where("pc = 0").select(B.wide_value(F.col("insn.imm"), F.col("high")).cast("string").alias("v")).first().v == str(9 << 32 | 5)
    assert sorted(r.pc for r in cfg.block_starts(rows).collect()) == [0, 2, 3, 4, 5, 6] and sorted(r.pc for r in cfg.function_starts(rows).collect()) == [0, 6]
    found = cfg.blocks(rows).cache()
    assert [(r.start, r.terminator, r.frame) for r in found.orderBy("start").collect()] == [(0, "fallthrough", 0), (2, "branch", 0), (3, "call", 0), (4, "jump", 0), (5, "exit", 0), (6, "exit", 1)]
    edges = cfg.successors(found).cache()
    assert sorted((r.src, r.dst, r.kind) for r in edges.collect()) == [(0, 1, "fallthrough"), (1, 2, "fallthrough"), (1, 4, "taken"), (2, 3, "return"), (2, 5, "callee"), (3, 1, "jump")]
    placed = cfg.numbered(cfg.numbered(rows, cfg.block_starts(rows), "block"), cfg.function_starts(rows), "frame").cache()
    reach = {(r.pc, r.reg, r.at) for r in cfg.reaching_definitions(found, placed, edges).collect()}
    assert {(2, 1, 0), (2, 1, 3), (7, 0, 6)} <= reach
    assert [(r.pc, r.how, r.fd, r.map_index) for r in cfg.map_bindings(rows).collect()] == [(0, "fd", 5, 0)]
    ranges = spark.createDataFrame([("r", "p", 0, 2)], "range_id string, program string, first_block int, last_block int")
    assert [r.slots for r in cfg.slot_counts(placed, ranges).collect()] == [4]
    assert [(r.pc) for r in cfg.matches(placed, (lambda i: i["code"] == 0xB7, lambda i: B.is_exit(i["code"]))).collect()] == [6]
    points = spark.createDataFrame([("p", 0, 5, 1)], "program string, frame bigint, pc int, reg int")
    assert [r.defined_at for r in cfg.previous_definition(placed, points).collect()] == [3]
    seen = spark.createDataFrame([("p", 1, "insn_delta"), ("p", 1, "pc_full"), ("p", 3, "pc_full")], "program string, pc int, kind string")
    assert sorted((r.pc, r.state_pc, r.kind) for r in cfg.states_by_site(rows, seen).collect()) == [(2, 1, "insn_delta"), (3, 3, "pc_full")]
    rates = spark.createDataFrame([(3, 1), (0, 0)], "t long, n long").select(cfg.rate(F.col("t"), F.col("n")).alias("r"), cfg.miss_rate(F.lit(float("nan"))).alias("m")).collect()
    assert [(r.r, r.m) for r in rates] == [(0.75, None), (None, None)]
    layout = spark.range(1).select(B.packet_layout(F.lit("packet"), F.lit("xdp")).alias("a"), B.packet_layout(F.lit("helper"), F.lit("xdp")).alias("b")).first()
    assert tuple(layout.a) == (0, 4) and layout.b is None


def test_corpus(spark):
    text = "func#0 @0\n; int x = 1; @ a.c:3\n0: (b7) r1 = 1\n1: (b7) r2 = 1\n; return *p; @ a.c:5\n2: (71) r3 = *(u8 *)(r1 +0)\nlibbpf: verifier log: x\nR1 invalid mem access 'scalar'\nprocessed 3 insns\nmust not count\n"
    lines = logs.lines(spark.createDataFrame([("a", text), ("b", "processed 1 insns\n"), ("c", "")], "log_id string, text string"), normalize=False).cache()
    got = {r.log_id: (r.terminal_error, r.rejected_pc, r.quality) for r in corpus.parsed_logs(lines).collect()}
    assert got == {"a": ("R1 invalid mem access 'scalar'", 2, "trace_rich"), "b": (None, None, "no_terminal_error"), "c": (None, None, "empty")}
    quoted = corpus.quoted_pcs(lines).cache()
    wanted = spark.createDataFrame([("a", "int x=1;"), ("a", "return 0;")], "log_id string, root_line string")
    assert [(r.root_line, r.pcs) for r in corpus.pcs_of_comment(quoted, wanted).collect()] == [("int x=1;", [0, 1])]
    labels = spark.createDataFrame([("a", 1, "int x = 1;"), ("a", 2, "int x = 1;"), ("a", 9, "return *p;"), ("a", 1, "return *p;")], "log_id string, root_pc int, root_line string")
    assert [r.error for r in corpus.misaligned_roots(labels, quoted).collect()] == ["root line is at [0, 1], not at 2", "root line is at [2], not at 9"] or len(corpus.misaligned_roots(labels, quoted).collect()) == 2
    old = spark.createDataFrame([("a", 1, "return *p;", "github_issue", 2, 1), ("a", 1, "return *p;", "selftest", 2, 1)], "log_id string, root_pc int, root_line string, source_kind string, rejected_pc int, legacy_pc int")
    assert corpus.shadowed_roots(old, quoted).count() == 1
    stored = spark.createDataFrame([("a", "R1 invalid mem access 'scalar'", 3, 77)], "log_id string, terminal_error string, rejected_pc int, root_pc int")
    assert ids(corpus.stored_mismatches(stored, corpus.parsed_logs(lines), quoted), "error") == ["rejected_pc", "root_pc"]
    cases = spark.createDataFrame([(1,), (2,)], "case_id int")
    report = corpus.case_report(cases, spark.createDataFrame([(2, "x"), (2, "y")], "case_id int, error string"))
    assert sorted(map(tuple, report.collect())) == [(1, 0, True), (2, 2, False)] and tuple(corpus.report_totals(report).first()) == (2, 1, 1)
    enums = spark.createDataFrame([(1, "a", ["x", "q"]), (2, "z", None)], "k int, f string, l array<string>")
    assert sorted(map(tuple, corpus.enum_violations(enums, "k", {"f": ("a",), "l": ("x",)}).collect())) == [(1, "l", "q"), (2, "f", "z")]


def test_loader(spark):
    text = "libbpf: loading object 'o'\nlibbpf: sec 'tp/skb': found program 'p'\nlibbpf: prog 'q': relo #0: <byte_off> [1] struct a.x\nlibbpf: prog 'q': relo #0: patched insn #1 (LDX) off 8 -> 9\nlibbpf: prog 'p': relo #0: <byte_off> [1] struct sock.x\nlibbpf: prog 'p': relo #0: patched insn #1 (LDX) off 8 -> 9\nfunc#1 @7\nlibbpf: prog 'p': -- BEGIN PROG LOAD LOG --\nx"
    lines = logs.lines(spark.createDataFrame([("a", text)], "log_id string, text string"), normalize=False)
    scopes = loader.program_scopes(lines, spark.createDataFrame([("a", 9)], "log_id string, before_line int"))
    assert [tuple(r) for r in loader.program_sections(lines, scopes).collect()] == [("a", 9, "p", 2, "tp/skb")]
    fields = lambda offset: spark.createDataFrame([("a", 1, offset)], "log_id string, pc int, offset int")
    assert [r.relocated_struct for r in loader.relocated_structs(lines, scopes, fields(9)).collect()] == ["sock"] and loader.relocated_structs(lines, scopes, fields(7)).count() == 0
    assert [tuple(r) for r in loader.function_starts(lines).collect()] == [("a", 1, 7)]
    programs = spark.createDataFrame([("a", "x", True), ("a", "y", True), ("b", "x", True), ("b", "y", False)], "log_id string, section string, attached boolean")
    assert [tuple(r) for r in loader.active_sections(programs).collect()] == [("b", "x")] and loader.mark_ambiguous(programs).where("ambiguous").count() == 2


def test_harness(spark):
    entries = harness.split_entries(spark.createDataFrame([(1, "a # x"), (2, ""), (3, "a"), (4, "b/c"), (5, "z")], "line_no int, line string")).cache()
    assert [tuple(r) for r in entries.orderBy("place").collect()] == [(1, "a", True), (3, "a", True), (4, "b/c", False), (5, "z", True)]
    assert [(r.case_id, r.problem) for r in harness.selected(entries, spark.createDataFrame([("a",), ("b/c",)], "case_id string")).orderBy("place").collect()] == [("a", "duplicate"), ("a", "duplicate"), ("b/c", None), ("z", "unknown")]
    report = '{"compile": {"returncode": 0}, "load": {"returncode": 1, "stderr": "bad"}, "functional": [{"name": "f", "passed": false}]}'
    df = spark.createDataFrame([(1, report, "int x;")], "c int, r string, s string")
    text = df.select(harness.retry_context(F.col("c"), F.col("r"), F.col("s")).alias("t")).first().t
    assert "Failure stage: verifier_load" in text and "```text\nbad\n```" in text and "Failed checks from previous attempt:\n```text\nf\n```" in text
    results = spark.createDataFrame([("r", "raw", "a", "pass", None, "1"), ("r", "raw", "a", "pass", "compile", "2"), ("r", "raw", "x", "fail", "odd", "1")], "run_id string, mode string, case_id string, status string, failure_stage string, prompt_sha256 string")
    expected = spark.createDataFrame([("a", "raw", "1"), ("b", "raw", "1")], "case_id string, mode string, sha256 string")
    assert sorted((r.case_id, r.problem) for r in harness.result_problems(results, expected).collect()) == [("a", "prompt"), ("a", "repeated"), ("a", "status"), ("b", "missing"), ("x", "not in the split"), ("x", "stage")]
    one = spark.range(1)
    assert one.select(harness.normalized_uname(F.lit("Linux box 6.1 x")).alias("u")).first().u == "Linux <host> 6.1 x" and one.select(harness.has_fingerprint(F.lit("a" * 64)).alias("u")).first().u
    files = spark.createDataFrame([("a", n) for n in ("buggy.bpf.c", "test.py", "verifier.log", "x")], "case_id string, name string")
    assert ids(harness.case_file_problems(files), "problem") == ["extra x", "missing diagnostic.txt"] and ids(harness.discovered(files), "case_id") == ["a"]
    shown = spark.createDataFrame([("a", "error[E001]: x\n  = class: source_bug\n  --> a.c:3\n   = required proof: y"), ("b", "x")], "case_id string, text string")
    assert [(r.case_id, r.problem) for r in harness.diagnostic_problems(shown).where("case_id = 'a'").collect()] == [("a", "action")]
    leak = spark.createDataFrame([("a", "int taxonomy_class;", "log", "diag")], "case_id string, source string, log string, diagnostic string")
    assert harness.prompt_problems(leak).count() == 4
    runs = spark.createDataFrame([("1", "s", "m", "k", "c"), ("2", "s", "n", "k", "c")], "run_id string, split_sha256 string, model string, kernel string, clang string")
    assert [(r.field, r["values"]) for r in harness.identity_problems(runs).collect()] == [("model", ["m", "n"])]


def test_parsed_diagnostics(spark):
    text = "error[E001]: short: more\n  = class: verifier_limit\n  = next action: Bounds\n  --> a/b.c:17\n   |\n17 | x\n   | - near\n   = note: nearest BPF instruction pc 9\n   = required proof: prove it\n   = warning: odd\nhelp: one\nhelp: two"
    r = spark.createDataFrame([(text,), ("no header",)], "t string").select(V.parsed(F.col("t")).alias("p")).collect()
    p = r[0].p
    assert (p.error_id, p.message, p.failure_class, p.next_action, p.required, p.path, p.line, p.pcs, p.help, p.related, p.analysis_error) == ("E001", "short: more", "verifier_limit", "Bounds", "prove it", "a/b.c", 17, [9], ["one", "two"], 1, "odd") and r[1].p is None


def test_sources(spark):
    one = spark.range(1)
    of = lambda c: one.select(c.alias("v")).first().v
    assert of(T.call_argument(F.lit("r = f(a, g(b, c), (void *)d);"), "f", 1)) == "g(b, c)" and of(T.call_argument(F.lit("r = f(a)"), "f", 1)) is None
    assert of(T.guard_bound(F.lit("if (i < 8 && j <= 3)"), F.lit("i"))) == 7 and of(T.guard_bound(F.lit("if (16 >= i)"), F.lit("i"))) == 16 and of(T.guard_bound(F.lit("if (i > 8)"), F.lit("i"))) is None
    assert of(T.addressed_name(F.lit("(void *)&map_a"))) == "map_a" and of(T.addressed_name(F.lit("x & y z"))) is None
    assert of(T.is_literal_null(F.lit("(void *) 0"))) and of(T.is_literal_null(F.lit("0UL"))) and not of(T.is_literal_null(F.lit("10")))
    assert of(T.guarded_pointer(F.lit("if (pos + 1 > data_end)"))) == "pos" and of(T.assigned_name(F.lit("u8 *pos = data + 4;"))) == "pos"


def test_stack_bytes(spark):
    slots = spark.createDataFrame([(-16, "0000mmmm", None), (-8, None, "scalar")], "off int, slot_types string, kind string")
    m = slots.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("off", F.struct("slot_types", F.when(F.col("kind").isNotNull(), F.struct(F.col("kind").alias("reg_type"))).alias("state"))))).alias("m"))
    got = m.select(*(sites.initialized_bytes(F.col("m"), F.lit(s)).alias(f"s{-s}") for s in (-16, -12, -24, -8))).first()
    assert tuple(got) == (16, 12, 0, 8)


def test_loops(spark):
    text = "5: (05) goto pc-3\ninfinite loop detected at insn 3\ncur state: R0=1 R2=2\nold state: R0=1 R2=3\n"
    lines = logs.lines(spark.createDataFrame([("a", text)], "log_id string, text string"))
    found = states.loop_snapshots(lines, spark.createDataFrame([("a", 2)], "log_id string, line_no int"))
    from logloom.functions import states as S

    assert [r.x for r in found.select(S.same_loop_state(F.col("current"), F.col("previous")).alias("x")).collect()] == [False]


def test_blocks_and_frames_in_one_pass(spark):
    """Random programs, wide loads and targets inside them included, against starts that are joined."""
    import random

    from logloom.operators import cfg

    rng, code = random.Random(5), []
    for program in range(30):
        pc = 0
        for _ in range(rng.randrange(1, 25)):
            insn = (rng.choice([0x05, 0x15, 0x85, 0x95, 0xB7, 0x18, 0x06]), 0, rng.choice([0, 1, 4]), rng.randrange(-6, 6), rng.randrange(-6, 6))
            code.append((program, pc, insn))
            pc += 2 if insn[0] == 0x18 else 1
    rows = spark.createDataFrame(code, "program int, pc int, insn struct<code:int,dst:int,src:int,off:int,imm:int>")
    want = cfg.numbered(cfg.numbered(rows, cfg.block_starts(rows), "block"), cfg.function_starts(rows), "frame")
    found = cfg.placed(rows)
    assert sorted(found.collect()) == sorted(want.select(*found.columns).collect())
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_bytes_of_an_offset_that_look_like_a_letter(spark):
    """Little-endian fields were turned round as text, which left a letter of two bytes as it was."""
    from pyspark.sql import functions as F

    from logloom.functions import bytecode as B

    raw = [bytes([0x61, 0x21, 0xC3, 0x28, 0xE2, 0x82, 0xAC, 0x80]), bytes([0x18, 0xFA, 0xFF, 0xFF, 0xFE, 0xFF, 0xFF, 0xFF]), b"short"]
    found = [r.i and tuple(r.i) for r in spark.createDataFrame([(bytearray(x),) for x in raw], "raw binary").select(B.decoded(F.col("raw")).alias("i")).collect()]
    assert found == [(0x61, 1, 2, 0x28C3, 0x80AC82E2 - (1 << 32)), (0x18, 10, 15, -1, -2), None]

"""Column functions on single values, against values known from the log format."""

import pytest
from pyspark.sql import functions as F

from logloom.functions import helpers as H
from logloom.functions import instructions as I
from logloom.functions import lines as L
from logloom.functions import messages as M
from logloom.functions import ranges as R
from logloom.functions import states as S


@pytest.fixture
def value(spark):
    def of(function, text, **more):
        df = spark.createDataFrame([(text,)], "x string")
        r = df.select(function(F.col("x"), **more).alias("v")).first().v
        return r.asDict(recursive=True) if hasattr(r, "asDict") else r

    return of


@pytest.mark.parametrize(
    ("line", "clean"),
    [
        ("\x1b[1;31m5: (b7) r0 = 0\x1b[0m\r", "5: (b7) r0 = 0"),
        ("[2024-05-01T10:11:12.5Z] 2024-05-01T10:11:12Z  x", "x"),
        ("2024-05-01 10:11:12 x", "2024-05-01 10:11:12 x"),
        ("  [not a stamp] x", "[not a stamp] x"),
        ("[2024-05-01 10:11:12]x", "x"),
    ],
)
def test_normalized(value, line, clean):
    assert value(L.normalized, line) == clean


@pytest.mark.parametrize(
    ("line", "is_error"),
    [
        ("invalid access to packet, off=0 size=1", True), ("R1 !read_ok", True), ("Back-EDGE from insn 1 to 2", True),
        ("5: (85) call bpf_spin_lock#93", False), ("5: R1=scalar() invalid ", False), ("from 1 to 2: invalid ", False), ("; invalid source", False),
        ("processed 7 insns invalid ", False), ("processed 1000001 insn", True), ("", False), ("libbpf: invalid ", False), ("all is well", False), ("nothing unKnown func", False), ("K unİt invalid x", True),
    ],
)
def test_error_lines(value, line, is_error):
    assert value(L.is_error, line) is is_error


def test_source_comment(value):
    assert value(L.source_comment, "; if (a @ b) @ dir/x.c:17") == {"text": "if (a @ b)", "path": "dir/x.c", "line": 17}
    assert value(L.source_comment, "no comment") is None


def test_instructions(value):
    load, store, call, branch = "(61) r1 = *(u32 *)(r10 -8)", "(7b) *(u64 *)(r3 +16) = r4", "(85) call bpf_map_lookup_elem#1", "(2d) if r1 > r2 goto pc+5"
    assert [value(I.access_width, t) for t in (load, store, call)] == [4, 8, None]
    assert [value(I.access_offset, t) for t in (load, store, "(61) r1 = *(u32 *)(r2)")] == [-8, 16, 0]
    assert [value(I.base_register, t) for t in (load, store)] == [10, 3]
    assert (value(I.is_load, load), value(I.is_store, load), value(I.is_store, store)) == (True, False, True)
    assert value(I.call_target, call) == "bpf_map_lookup_elem"
    assert value(I.branch_registers, branch) == [1, 2] and value(I.branch_registers, load) is None
    assert value(I.branch_target, branch, at=F.lit(10)) == 16
    assert value(I.copy_source, "(bf) r6 = r1") == 1 and value(I.added_register, "(0f) r2 += r3") == 3
    assert value(I.writes, call, register=F.lit(5)) and not value(I.writes, call, register=F.lit(6)) and value(I.writes, load, register=F.lit(1))
    assert value(I.reads, load, register=F.lit(10)) and not value(I.reads, load, register=F.lit(1))
    assert value(I.tail, "12: 0.234 (95) exit") == "(95) exit" and value(I.pc, "12: (95) exit") == 12


def test_messages(value):
    assert value(M.stack_read, "invalid read from stack R2 off -16+4 size 8") == {"register": 2, "base": -16, "delta": 4, "size": 8, "start": -12, "end": -4}
    assert value(M.stack_read, "R1 bad; invalid read from stack off -8 size 4")["start"] == -8 and value(M.stack_read, "invalid read from stacks off -8 size 4") is None
    assert value(M.stack_write, "invalid write to stack R1 off=-520 size=8") == {"start": -520, "end": -512}
    assert value(M.stack_write, "Invalid WRITE to stack off -8 size -1") is None
    assert value(M.map_value_access, "invalid access to map value, value_size=16 off=0x10 size=4") == {"value_size": 16, "off": 16, "size": 4}
    assert value(M.map_value_access, "invalid access to map value, value_size=16 off=1") is None and value(M.map_value_access, "value_size=16 off=1 size=1") is None
    assert value(M.signed_after, "xoff=1 off=a off=-0x2", mark="off=") == -2 and value(M.signed_after, "off=0xffffffffffffffff", mark="off=") is None
    assert value(M.required_return_range, "R0 should have been in [-1, 1]") == {"lo": -1, "hi": 1}
    assert value(M.helper, "cannot use helper bpf_x#7: no") == "bpf_x#7" and value(M.helper, "into func f, unknown func g") == "g" and value(M.helper, "calling f") is None
    assert value(M.argument_register, "arg#4 bad") == 5 and value(M.argument_register, "arg#5 bad") is None
    assert value(M.argument_register_after, "args#2", mark="args#") == 3 and value(M.zero_based_argument, "arg#-1", mark="arg#") is None
    assert value(M.packet_required, "off=14 size=4") == 18 and value(M.packet_required, "off=-9 size=4") is None
    assert value(M.called_function, "a ('x') b ('f_1')") == "f_1"
    assert value(M.is_context_access, "Invalid CTX access off=1") and not value(M.is_context_access, "invalid access")
    assert value(M.names_packet_end, "R1 pointer arithmetic on pkt_end prohibited") and value(M.is_pointer_arithmetic_or_bitwise, "bitwise operator") and value(M.is_scalar_access, "R1 invalid mem access 'inv'")


def test_states(value, spark):
    s = value(S.state, "from 3 to 7 (speculative execution): frame1: R0=5 R1_w=scalar(id=2,smin=umin=1,umax=255,var_off=(0x0; 0xff)) R2=Pfp[1]-16 R10=fp0 fp-8_w=mmmm0000 fp-16=ctx cb refs=2,4")
    assert (s["pc"], s["from_pc"], s["kind"], s["speculative"], s["frame"]) == (7, 3, "edge_full", True, 1)
    df = spark.createDataFrame([(s["tokens"],)], "t array<string>")
    r = {x.reg: x.state for x in df.select(S.registers(F.col("t")).alias("r")).first().r}
    assert (r[0].reg_type, r[0].exact) == ("scalar", 5)
    assert (r[1].narrow, r[1].id, r[1].smin, r[1].umin, r[1].umax, r[1].tnum_value, r[1].tnum_mask, r[1].exact) == (True, 2, 1, 1, 255, 0, 255, None)
    assert (r[2].reg_type, r[2].precise, r[2].off, r[2].source_frame) == ("fp", True, -16, 1)
    assert (r[10].reg_type, r[10].off) == ("fp", 0)
    slots = [tuple(x) for x in df.select(S.slots(F.col("t")).alias("s")).first().s]
    assert slots == [(-8, "mmmm0000", None), (-16, None, "ctx")]
    assert df.select(S.references(F.col("t")).alias("x")).first().x == [2, 4]
    assert value(S.state, "5: (61) r0 = *(u32 *)(r1 +0) ; R0_w=scalar() R1=pkt(off=0,r=14)")["kind"] == "insn_delta"
    assert value(S.state, "5: (2d) if r1 > r2 goto pc+5 ; R1=pkt(r=1)")["kind"] == "branch_delta"
    assert value(S.state, "224: (85) call bpf_tail_call#12       ;") is None


def test_wide_numbers(value):
    assert value(S.unsigned, "0xffffffffffffffff") == 18446744073709551615 == value(S.unsigned, "-1")
    assert value(S.signed, "0xffffffffffffffff") == -1 and value(S.signed, "-5") == -5 and value(S.signed, "x") is None


def test_state_forms(value, spark):
    def state(text, narrow=False):
        r = spark.createDataFrame([(text,)], "x string").select(S.register_state(F.col("x"), F.lit(narrow)).alias("s")).first().s
        return {k: int(v) if type(v).__name__ == "Decimal" else v for k, v in r.asDict().items() if v is not None and v is not False}

    minus = {"reg_type": "scalar", "exact": (1 << 64) - 5, "smin": -5, "smax": -5, "umin": (1 << 64) - 5, "umax": (1 << 64) - 5, "smin32": -5, "smax32": -5, "umin32": (1 << 32) - 5, "umax32": (1 << 32) - 5}
    assert state("-5") == minus and state("P-5") == minus | {"precise": True}
    assert state("0x10", narrow=True) == {"reg_type": "scalar", "narrow": True, "exact": 16, "smin32": 16, "smax32": 16, "umin32": 16, "umax32": 16}
    assert state("pkt(id=3,off=14,r=20,imm=0)") == {"reg_type": "pkt", "id": 3, "off": 14, "packet_range": 20}
    assert state("mem(mem_size=8,ref_obj_id=4)") == {"reg_type": "mem", "mem_size": 8} and state("ringbuf_mem(ref_id=2,sz=8)") == {"reg_type": "ringbuf_mem", "ref_id": 2, "mem_size": 8}
    assert state("map_value(off=4,ks=4,vs=48,smin_value=umin_value=1,umax=9)") == {"reg_type": "map_value", "off": 4, "map_value_size": 48, "smin": 1, "umin": 1, "umax": 9}
    assert state("scalar(smin=0xzz,umin=5,umin=-1,smax32=0xffffffff)") == {"reg_type": "scalar"}  # an invalid value overwrites
    assert state("scalar(umin32=7,umax32=7)") == {"reg_type": "scalar", "narrow": True, "exact": 7, "umin32": 7, "umax32": 7}
    assert state("inv(var_off=(0x4; 0x0))") == {"reg_type": "scalar", "exact": 4, "tnum_value": 4, "tnum_mask": 0}
    assert state("fp") == {"reg_type": "fp"} and state("fp[1]-0x8") == {"reg_type": "fp", "source_frame": 1, "off": -8} and state("scalar") == {"reg_type": "scalar"}


def test_malformed_states(value):
    bad = ["5: R1=foo(bar", "5: R1=foo(bar R2=1", "5: R1=fpx", "from 3 to x: R1=1", "5: (b7) r1 = 0 ; Rx=1"]
    good = ["5: R1=1", "5: (b7) r1 = 0 ; R1=1", "5: (85) call f#1 ;", "no state", "5: R2=1 R1=foo(bar", "5: (95) exit ; refs=2", "Rules: R is a letter"]
    assert [value(S.malformed, x) for x in bad] == [True] * len(bad)
    assert [value(S.malformed, x) for x in good] == [False] * len(good)


def test_repeated_registers(value, spark):
    tokens = value(S.state, "5: R1=1 R2=2 R1=3 refs=3")["tokens"]
    df = spark.createDataFrame([(tokens,)], "t array<string>")
    found = df.select(S.registers(F.col("t")).alias("r"), S.reference_count(F.col("t")).alias("n"), S.callback(F.col("t")).alias("c")).first()
    assert [(x.reg, int(x.state.exact)) for x in found.r] == [(2, 2), (1, 3)] and found.n == 3 and found.c is None


_STATE = "reg_type string, narrow boolean, exact decimal(20,0), tnum_value decimal(20,0), smin long, smax long, umin decimal(20,0), umax decimal(20,0), smin32 int, smax32 int, umin32 long, umax32 long, off int, map_value_size int"


@pytest.fixture
def judged(spark):
    """What a function says of a state, all fields of which are null but for those given."""

    def of(function, **fields):
        names = [x.split()[0] for x in _STATE.split(", ")]
        row = tuple({"reg_type": "scalar", "narrow": False, **fields}.get(n) for n in names)
        row = tuple(__import__("decimal").Decimal(v) if n in ("exact", "tnum_value", "umin", "umax") and v is not None else v for n, v in zip(names, row, strict=True))
        df = spark.createDataFrame([(row,)], f"r struct<{', '.join(x.replace(' ', ': ', 1) for x in _STATE.split(', '))}>")
        return df.select(function(F.col("r")).alias("v")).first().v

    return of


def test_missing_bounds_are_unsafe(judged):
    assert judged(R.unsafe) and judged(R.unsafe, smin=0, smax=10) and judged(R.unsafe, smin=0, umin=0, umax=1 << 40)
    assert not judged(R.unsafe, smin=0, umin=0, umax=10)
    assert judged(R.may_be_negative) and not judged(R.may_be_negative, umin=0) and judged(R.may_be_negative, smin=-1, umin=0) and judged(R.may_be_negative, exact=1 << 63)
    assert judged(R.too_large, smax=5, umax=1 << 40) and judged(R.too_large) and not judged(R.too_large, smax=5)
    assert judged(R.may_include_zero, smin=-3) and not judged(R.may_include_zero, smin=-3, umin=1) and not judged(R.may_include_zero, smax=-1)


def test_views_of_required_ranges(judged):
    within = lambda lo, hi: lambda r: R.outside(r, F.lit(lo), F.lit(hi))
    assert judged(within(0, 5)) and judged(within(0, 5), smin=0, umax=5) and not judged(within(0, 5), smin=0, smax=5)
    assert not judged(within(0, 5), umin=0, umax=5) and judged(within(-1, 5), umin=0, umax=5) and not judged(within(-1, 5), smin32=0, smax32=5)
    assert not judged(within(-5, 5), exact=(1 << 64) - 3) and not judged(within(-5, 5), exact=(1 << 32) - 3, narrow=True) and judged(within(-5, 5), exact=(1 << 32) - 3)
    assert not judged(within(0, 1), exact=7, reg_type="pkt")
    assert not judged(lambda r: R.at_most(r, F.lit(10)), smax=-1) and judged(lambda r: R.at_most(r, F.lit(10)), exact=10)


def test_map_values(judged):
    exceeds = lambda size: lambda r: R.access_may_exceed(r, F.lit(size))
    value = {"reg_type": "map_value", "map_value_size": 16}
    assert judged(exceeds(17), **value) and not judged(exceeds(16), **value) and judged(exceeds(1), off=8, umax=8, **value)
    assert judged(R.offset_may_exceed, umax=16, **value) and not judged(R.offset_may_exceed, **value) and not judged(R.offset_may_exceed, umax=99, map_value_size=16)
    assert judged(R.value_summary, off=4, smin=0, **value) == "map_value(off=4,value_size=16,range(smin=0))" and judged(R.value_summary) == "scalar with unknown bounds"
    assert judged(R.summary, exact=5) == "scalar exact 5" and judged(R.summary, smin=-1, umax=3, smax32=9) == "scalar(smin=-1,umax=3)"


def test_helper_roles(value, spark):
    assert value(lambda c: H.stack_output_pair(c).first, "bpf_d_path") == 2 and value(lambda c: H.stack_output_pair(c).second, "16") == 2
    assert value(lambda c: H.probe_read_value_pair(c).second, "113") == 2 and value(lambda c: H.stack_read_pair(c).first, "bpf_dynptr_slice") == 3
    assert value(lambda c: H.writable_stack_output_pair(c).first, "bpf_probe_read_kernel") is None and value(lambda c: H.map_value_access_pair(c).first, "114") == 1
    assert [value(H.scalar_length_register, h) for h in ("bpf_perf_event_output", "113", "x")] == [5, 2, None]
    assert [value(H.consumes_scalar_length, "bpf_csum_diff", register=F.lit(r)) for r in (2, 4, 5)] == [True, True, False]
    roles = {"dynptr_output": H.dynptr_output, "dynptr_live": H.dynptr_live, "dynptr_initialized": H.dynptr_initialized, "dynptr_data_producer": H.dynptr_data_producer, "dynptr_data_invalidating": H.dynptr_data_invalidating}
    for r in H.dimension(spark).collect():
        if r.role in roles:
            assert value(roles[r.role], r.helper) == r.first_register
    assert value(H.dynptr_backing, "bpf_dynptr_from_mem") == "memory"


def test_instruction_details(value):
    assert value(I.atomic_width, "(db) lock *(u64 *)(r1 +0) += r2") == 8 and value(I.atomic_width, "(7b) *(u64 *)(r1 +0) = r2") is None
    assert value(I.direct_call_target, "(85) call f#3") == "f" and value(I.direct_call_target, "(86) call f#3") is None
    assert value(I.single_source, "(bc) w1 = (s8)r2") is None and value(I.single_source, "(bf) r1 = r2 ; R1=1") == 2 and value(I.copy_source, "(bc) w1 = w2") is None
    assert value(I.assigns, "(85) call f", register=F.lit(0)) and value(I.assigns, "(0f) w2 += r3", register=F.lit(2)) and not value(I.assigns, "(7b) *(u64 *)(r2 -8) = r1", register=F.lit(2))
    assert value(I.uses, "(0f) r10 += r1", register=F.lit(1)) and not value(I.uses, "(0f) r10 += r2", register=F.lit(1))
    assert value(I.adds, "(0f) r2 += r3", into=F.lit(2), register=F.lit(3)) and not value(I.adds, "(0f) r2 += r3", into=F.lit(3), register=F.lit(2))
    assert not value(I.reads, "(bf) r1 = r2", register=F.lit(2)) and value(I.reads, "(7b) *(u64 *)(r10 -8) = r1", register=F.lit(10)) and value(I.reads, "(2d) if r1 > r2 goto pc+5", register=F.lit(2))
    assert value(I.register_token, "r7,") == 7 and value(I.register_token, "w7") is None and value(I.write_token, "w7;") == 7
    assert value(I.opens_validation, "Validating f() func#1...") and value(I.closes_validation, "Func#1 ('f') is safe for any args that match its prototype")

"""Facts about registers against a walk over the instructions one by one."""

import random

import pytest

from logloom.operators import facts

I32, I64 = 1 << 31, 1 << 63
LAYOUT = {"xdp": (0, 4), "sched_cls": (76, 80), "kprobe": None}


def walked(code, layout):
    """{(pc, reg): fact} of a program [(code, dst, src, off, imm)], a wide load followed by its second slot."""
    wide = [False] * len(code)
    pc, insns = 0, []
    while pc < len(code):
        insns.append(pc)
        wide[pc] = code[pc][0] == 0x18
        pc += 1 + wide[pc]
    jump = lambda pc: pc + 1 + (code[pc][4] if code[pc][0] == 0x06 else code[pc][3])
    is_cond = lambda c: c & 7 in (5, 6) and c & 0xF0 not in (0, 0x80, 0x90)
    is_ja = lambda c: c in (0x05, 0x06)
    pseudo = lambda pc: code[pc][0] == 0x85 and code[pc][2] == 1
    starts = {0}
    for pc in insns:
        c = code[pc]
        if is_cond(c[0]) or is_ja(c[0]):
            starts |= {jump(pc), pc + 1}
        if c[0] == 0x95 or pseudo(pc):
            starts.add(pc + 1)
        if pseudo(pc) or (c[0] == 0x18 and c[2] == 4):
            starts.add(pc + 1 + c[4])
    starts = sorted(s for s in starts if s in insns)
    block_of = {pc: sum(s <= pc for s in starts) - 1 for pc in insns}
    last = {block_of[pc]: pc for pc in insns}
    preds = {b: set() for b in last}
    falls = {}
    for b, pc in last.items():
        c, after = code[pc], pc + 1 + wide[pc]
        to = [jump(pc)] if is_ja(c[0]) else [jump(pc), after] if is_cond(c[0]) else [pc + 1 + c[4], after] if pseudo(pc) else [] if c[0] == 0x95 else [after]
        falls[b] = not (is_ja(c[0]) or pseudo(pc) or c[0] == 0x95)
        for t in to:
            if t in starts:
                preds[starts.index(t)].add(b)
    regs, data, out, block = {}, None, {}, -1
    for pc in insns:
        if block_of[pc] != block:
            block = block_of[pc]
            if block == 0:
                regs, data = {1: ("context", None, None), 10: ("frame", 0, None)}, None
            elif not (preds[block] == {block - 1} and falls[block - 1]):
                regs, data = {10: ("frame", 0, None)}, None
        out |= {(pc, r): f for r, f in regs.items() if f}
        op, dst, src, off, imm = code[pc]
        old = regs.get(dst)
        k = op & 7
        if op == 0x85 and src == 4:
            regs[0] = None  # of the tests' descriptor
        elif op == 0x85:
            for r in range(6):
                regs[r] = None
            regs = {r: f for r, f in regs.items() if f and f[0] not in ("packet", "packet_end")}
            data = None
        elif op == 0xB7 and src == 3:
            pass
        elif op == 0x18:
            v = (imm & 0xFFFFFFFF) | (code[pc + 1][4] & 0xFFFFFFFF) << 32
            regs[dst] = ("const", v - (1 << 64) if v >= I64 else v, None)
        elif k == 7:
            new = None
            if op == 0xB7:
                new = ("const", imm, None)
            elif op == 0xBF:
                new = regs.get(src)
            elif op in (0x07, 0x17) and old:
                d = imm if op == 0x07 else -imm
                if old[0] == "const" and -I64 <= old[1] + d < I64:
                    new = ("const", old[1] + d, None)
                elif old[0] == "frame" and -I32 <= old[1] + d < I32:
                    new = ("frame", old[1] + d, None)
                elif old[0] == "packet" and op == 0x07:
                    new = ("packet", max(-I32, min(I32 - 1, old[1] + d)), old[2])
            regs[dst] = new
        elif k == 4:
            new = None
            given = regs.get(src) if op == 0xBC else old
            if op == 0xB4:
                new = ("const", imm & 0xFFFFFFFF, None)
            elif given and given[0] == "const" and op in (0xBC, 0x04, 0x14):
                new = ("const", (given[1] + {0xBC: 0, 0x04: imm, 0x14: -imm}[op]) & 0xFFFFFFFF, None)
            regs[dst] = new
        elif k == 1:
            base = regs.get(src)
            regs[dst] = None
            if layout and op == 0x61 and base and base[0] == "context":
                if off == layout[0]:
                    regs[dst], data = ("packet", 0, pc), pc
                elif off == layout[1]:
                    regs[dst] = ("packet_end", None, pc if data is None else data)
        elif k == 0:
            regs[dst] = None
    return insns, out


def checked(spark, programs):
    """Runs programs {name: (type, code)} and compares the facts of all registers at all instructions."""
    rows, points, want = [], [], {}
    for name, (kind, code) in programs.items():
        insns, found = walked(code, LAYOUT[kind])
        for pc in insns:
            rows.append((name, pc, code[pc], code[pc + 1][4] if code[pc][0] == 0x18 else None))
            points += [(name, pc, r) for r in range(11)]
        want |= {(name, *k): f for k, f in found.items()}
    df = spark.createDataFrame(rows, "program string, pc int, insn struct<code:int,dst:int,src:int,off:int,imm:int>, high int")
    types = spark.createDataFrame([(n, k) for n, (k, _) in programs.items()], "program string, program_type string")
    kinsn = df.where("insn.code = 133 and insn.src = 4").selectExpr("program", "pc", "0 as reg")
    got = facts.register_facts(df, spark.createDataFrame(points, "program string, pc int, reg int"), types, kinsn).collect()
    assert len(got) == len(points)
    assert {(r.program, r.pc, r.reg): (r.kind, r.value, r.made_at) for r in got if r.kind} == want
    return want


WIDE = [(0x18, 3, 0, 0, -1), (0, 0, 0, 0, I32 - 1)]
PROGRAMS = {
    "sums": ("kprobe", [(0xB7, 2, 0, 0, 7), (0xBF, 3, 2, 0, 0), (0x07, 3, 0, 0, -9), (0x17, 3, 0, 0, 4), (0xBF, 4, 3, 0, 0), (0xAF, 3, 3, 0, 0), (0xBC, 5, 4, 0, 0), (0x04, 5, 0, 0, 8), (0x07, 5, 0, 0, -20), (0x14, 5, 0, 0, 1), (0x95, 0, 0, 0, 0)]),
    "overflow": ("kprobe", [*WIDE, (0xBF, 4, 3, 0, 0), (0x07, 3, 0, 0, 1), (0x17, 3, 0, 0, 1), (0x17, 4, 0, 0, 1), (0x07, 4, 0, 0, 1), (0xBC, 4, 3, 0, 0), (0x95, 0, 0, 0, 0)]),
    "frame": ("kprobe", [(0xBF, 2, 10, 0, 0), (0x07, 2, 0, 0, -16), (0x07, 2, 0, 0, -I32), (0x07, 2, 0, 0, 99), (0xBC, 3, 10, 0, 0), (0x04, 10, 0, 0, 1), (0x95, 0, 0, 0, 0)]),
    "packet": ("xdp", [(0xBF, 6, 1, 0, 0), (0x61, 3, 6, 4, 0), (0x61, 2, 6, 0, 0), (0x61, 3, 6, 4, 0), (0xBF, 7, 2, 0, 0), (0x07, 7, 0, 0, 14), (0xBF, 8, 3, 0, 0), (0x07, 8, 0, 0, 1), (0x17, 2, 0, 0, 1), (0x07, 7, 0, 0, I32 - 1), (0x07, 7, 0, 0, -5), (0x85, 0, 0, 0, 9), (0xBF, 9, 7, 0, 0), (0x61, 4, 6, 4, 0), (0x61, 4, 6, 8, 0), (0x95, 0, 0, 0, 0)]),
    "no layout": ("kprobe", [(0x61, 2, 1, 0, 0), (0x61, 3, 1, 4, 0), (0x95, 0, 0, 0, 0)]),
    "changed context": ("sched_cls", [(0x07, 1, 0, 0, 4), (0x61, 2, 1, 76, 0), (0x95, 0, 0, 0, 0)]),
    "kinsn": ("sched_cls", [(0x61, 2, 1, 76, 0), (0xB7, 0, 0, 0, 1), (0xB7, 5, 3, 2, 9), (0x85, 0, 4, 0, 77), (0x61, 3, 1, 80, 0), (0xBF, 4, 5, 0, 0), (0x95, 0, 0, 0, 0)]),
    "joins": ("xdp", [(0xB7, 2, 0, 0, 1), (0x15, 2, 0, 2, 5), (0x07, 2, 0, 0, 3), (0xBF, 3, 1, 0, 0), (0xBF, 4, 2, 0, 0), (0x15, 4, 0, 0, 1), (0xBF, 5, 4, 0, 0), (0x85, 0, 1, 0, 1), (0xBF, 6, 2, 0, 0), (0xBF, 7, 10, 0, 0), (0x95, 0, 0, 0, 0)]),
}


def test_by_hand(spark):
    want = checked(spark, PROGRAMS)
    assert want["sums", 5, 3] == ("const", -6, None) and want["overflow", 6, 4] == ("const", I64 - 2, None) and ("overflow", 3, 3) in want and ("overflow", 4, 3) not in want
    assert want["packet", 4, 3] == ("packet_end", None, 2) and want["packet", 2, 3] == ("packet_end", None, 1) and want["packet", 11, 7] == ("packet", I32 - 6, 2) and ("packet", 12, 7) not in want


@pytest.mark.parametrize("seed", range(3))
def test_random_programs(spark, seed):
    rng = random.Random(seed)
    ops = [0xB7, 0xBF, 0xBF, 0x07, 0x07, 0x17, 0xB4, 0xBC, 0x04, 0x14, 0xAF, 0x0F, 0x61, 0x61, 0x69, 0x7B, 0x18, 0x15, 0x05, 0x06, 0x85, 0x95, 0x20]
    programs = {}
    for n in range(25):
        code = []
        for _ in range(rng.randint(1, 40)):
            op = rng.choice(ops)
            src = rng.choice((0, 1, 1, 2, 3, 4, 6)) if op not in (0x85, 0xB7) else rng.choice((0, 0, 3 if op == 0xB7 else 4, 0 if op == 0xB7 else 1))
            off = rng.choice((0, 1, 2, 3)) if op in (0x15, 0x05) else rng.choice((0, 4, 76, 80))
            imm = rng.choice((0, 1, 3)) if op in (0x06, 0x85) else rng.choice((0, 1, -7, 100, I32 - 1, -I32))
            code.append((op, rng.randint(0, 7), src, off, imm))
            if op == 0x18:
                code.append((0, 0, 0, 0, rng.choice((0, -1, I32 - 1, -I32))))
        programs[f"p{n}"] = (rng.choice(sorted(LAYOUT)), code + [(0x95, 0, 0, 0, 0)])
    checked(spark, programs)


def test_a_long_chain(spark):
    code = [(0xB7, 2, 0, 0, 5)] + [(0x07, 2, 0, 0, 1 + i % 3) for i in range(300)] + [(0x95, 0, 0, 0, 0)]
    assert checked(spark, {"long": ("kprobe", code)})["long", 301, 2] == ("const", 5 + 600, None)


def test_no_instructions(spark):
    df = spark.createDataFrame([], "program string, pc int, insn struct<code:int,dst:int,src:int,off:int,imm:int>, high int")
    assert facts.register_facts(df, df.selectExpr("program", "pc", "0 as reg"), df.selectExpr("program", "'xdp' as program_type")).collect() == []


def test_settled_chains_are_not_written_again(spark, monkeypatch):
    """One chain of 300 steps takes nine rounds; a thousand chains of one step beside it are written in the first only."""
    from pyspark.sql import functions as F

    written = []

    def kept(df):
        found = df.localCheckpoint()
        written.append(found.count())
        return found

    monkeypatch.setattr(facts, "kept", kept)
    links = spark.createDataFrame([(0, k, 1, k - 1, 1) for k in range(1, 301)] + [(p, 5, 2, 0, 1) for p in range(1, 1001)], "program int, pc int, reg int, up_pc int, up_reg int")
    rows = facts.folded(links.withColumn("chain", facts.chain(F.lit("add"), F.lit(1).cast("long")))).collect()
    assert len(rows) == 1300 and {(r.root_pc, r.root_reg) for r in rows} == {(0, 1)} and all(r.chain["sum"] == (r.pc if r.program == 0 else 1) for r in rows)
    assert len(written) >= 9 and sum(written[1:]) < 300 * len(written)

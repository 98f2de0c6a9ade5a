"""Compacted programs run as the ones that they come from: same instructions, same decisions."""

import random

import pytest

from logloom.operators import graph, rewriting

SCHEMA = "program string, pc int, insn struct<code:int,dst:int,src:int,off:int,imm:int>, high int"


def rows_of(programs):
    out = []
    for name, code in programs.items():
        pc = 0
        while pc < len(code):
            wide = code[pc][0] == 0x18
            out.append((name, pc, code[pc], code[pc + 1][4] if wide else None))
            pc += 1 + wide
    return out


def traced(at, decide, steps):
    """What a program does: its instructions but for jumps, with the functions that references name traced by what they start with."""
    pc, stack, out = 0, [], []
    hops = 0
    while len(out) < steps and hops < 10 * steps:
        hops += 1
        if pc not in at:
            out.append("out")
            break
        code, dst, src, off, imm = at[pc]
        if code in (0x05, 0x06):
            pc += 1 + (imm if code == 0x06 else off)
        elif code == 0x15:
            taken = decide(len(out))
            out.append((code, dst, imm, taken))
            pc += 1 + (off if taken else 0)
        elif code == 0x85 and src == 1:
            out.append("call")
            if len(stack) < 6:
                stack.append(pc + 1)
                pc += 1 + imm
            else:
                pc += 1
        elif code == 0x95:
            out.append("exit")
            if not stack:
                break
            pc = stack.pop()
        elif code == 0x18:
            out.append((code, dst, src, None if src == 4 else imm))
            pc += 2
        else:
            out.append((code, dst, src, imm))
            pc += 1
    return out


def checked(spark, programs, seeds=range(6)):
    source = rows_of(programs)
    got = rewriting.compacted(spark.createDataFrame(source, SCHEMA)).collect()
    assert not [r for r in got if r.problem]
    for name in programs:
        old = {pc: insn for n, pc, insn, _ in source if n == name}
        mine = sorted((r for r in got if r.program == name), key=lambda r: r.pc)
        new = {r.pc: tuple(r.insn) for r in mine}
        at = 0
        for r in mine:
            assert r.pc == at
            at += 2 if r.insn.code == 0x18 else 1
        for seed in seeds:
            decide = lambda k, seed=seed: random.Random(f"{seed} {k}").random() < 0.5
            assert traced(new, decide, 60) == traced(old, decide, 60), (name, programs[name], new)
    return {name: [tuple(r.insn) for r in sorted((r for r in got if r.program == name), key=lambda r: r.pc)] for name in programs}


def mov(k):
    return (0xB7, k % 10, 0, 0, k)


EXIT = (0x95, 0, 0, 0, 0)


def ja(off):
    return (0x05, 0, 0, off, 0)


def test_by_hand(spark):
    programs = {
        "straight": [mov(1), ja(1), mov(9), mov(2), EXIT],
        "three": [mov(1), ja(3), mov(3), EXIT, mov(9), mov(2), ja(-5), EXIT],
        "nothing to do": [mov(1), (0x15, 1, 0, 1, 5), mov(2), mov(3), EXIT],
        "shared": [(0x15, 1, 0, 2, 5), mov(1), ja(1), mov(2), mov(3), EXIT],
        "loop": [mov(1), mov(2), (0x15, 1, 0, 1, 0), ja(-3), EXIT],
        "functions": [(0x18, 1, 4, 0, 5), (0, 0, 0, 0, 0), (0x85, 0, 1, 0, 5), EXIT, mov(8), EXIT, mov(4), EXIT, mov(5), EXIT],
        "only jumps": [ja(0), ja(0), EXIT],
    }
    new = checked(spark, programs)
    assert new["straight"] == [mov(1), mov(2), EXIT] and new["three"] == [mov(1), mov(2), mov(3), EXIT] and new["nothing to do"] == programs["nothing to do"] and new["only jumps"] == [EXIT]
    assert len(new["functions"]) == 7


@pytest.mark.parametrize("seed", range(3))
def test_random_programs(spark, seed):
    rng = random.Random(seed)
    programs = {}
    for n in range(30):
        size = rng.randint(2, 25)
        code = []
        while len(code) < size:
            at = len(code)
            kind = rng.random()
            to = rng.randint(0, size) - at - 1
            code.append(ja(to) if kind < 0.25 else (0x15, 1, 0, to, at) if kind < 0.4 else (0x06, 0, 0, 0, to) if kind < 0.45 else (0x85, 0, 1, 0, to) if kind < 0.5 else EXIT if kind < 0.55 else mov(at))
        programs[f"p{n}"] = [*code, EXIT]
    checked(spark, programs)


def test_chain_places(spark):
    links = [("a", k, k + 1) for k in range(1, 40)] + [("a", 100, 101), ("b", 1, 7), ("b", 7, 3), ("c", 1, 2), ("c", 2, 1), ("c", 5, 6)]
    got = {(r.k, r.node): (r.head, r.place) for r in graph.chain_places(spark.createDataFrame(links, "k string, node int, next int"), ["k"]).collect()}
    want = {("a", k): (1, k - 1) for k in range(2, 41)} | {("a", 101): (100, 1), ("b", 7): (1, 1), ("b", 3): (1, 2), ("c", 6): (5, 1)}
    assert got == want

"""Loaded programs against a walk that appends each function when it meets its first call."""

import random

import pytest

from logloom.operators import linking

CODE = "object string, section int, slot int, insn struct<code:int,dst:int,src:int,off:int,imm:int>"
SECTIONS, SYMBOLS = "object string, section int, name string", "object string, symbol int, section int, kind string, offset long, size long"
RELOCATIONS = "object string, section int, offset long, kind string, size int, target_symbol int, target_section int"


def call(imm):
    return (0x85, 0, 1, 0, imm)


def other(k):
    return (0xB7, k % 10, 0, 0, k)


class Refused(Exception):
    pass


def walked(obj, entry):
    """[insn] of a loaded entry section; obj: code {section: [insn]}, functions [(section, start, count)], moved {(section, slot): (section, base)}."""
    code, functions, moved = obj["code"], obj["functions"], obj["moved"]
    out, at, done, open_ = [], {}, set(), []

    def append(piece):
        if piece not in at:
            at[piece] = len(out)
            out.extend(code[piece[0]][piece[1] : piece[1] + piece[2]])
        return at[piece]

    def relocate(piece):
        if piece in open_:
            raise Refused("recursion")
        if piece in done:
            return
        open_.append(piece)
        section, start, count = piece
        for k in range(count):
            insn = code[section][start + k]
            if insn[0] == 0x85 and insn[2] == 1:
                to, base = moved.get((section, start + k), (section, start + k))
                to_slot = base + insn[4] + 1
                hit = max((f for f in functions if f[0] == to and f[1] <= to_slot < f[1] + f[2]), key=lambda f: f[1], default=None)
                if hit is None:
                    raise Refused("no function")
                where = append(hit)
                relocate(hit)
                out[at[piece] + k] = call(where - at[piece] - k - 1)
        open_.pop()
        done.add(piece)

    whole = (entry, 0, len(code[entry]))
    append(whole)
    relocate(whole)
    return out


def tables(spark, objects):
    code = [(o, s, k, i) for o, x in objects.items() for s, insns in x["code"].items() for k, i in enumerate(insns)]
    sections = [(o, s, x["names"][s]) for o, x in objects.items() for s in x["names"]]
    symbols = [(o, n, *y) for o, x in objects.items() for n, y in enumerate(x["symbols"])]
    relocations = [(o, *y) for o, x in objects.items() for y in x["relocations"]]
    return spark.createDataFrame(code, CODE), spark.createDataFrame(sections, SECTIONS), spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(relocations, RELOCATIONS)


def checked(spark, objects):
    got = {}
    for r in linking.loaded(*tables(spark, objects)).collect():
        got.setdefault((r.object, r.entry), []).append((r.slot, tuple(r.insn), r.problem))
    want = {}
    for o, x in objects.items():
        for s, name in x["names"].items():
            if name in (".text", "license", "maps", ".data") or not x["code"].get(s):
                continue
            try:
                want[o, s] = [(k, i, None) for k, i in enumerate(walked(x, s))]
            except Refused as why:
                want[o, s] = [(k, i, str(why)) for k, i in enumerate(x["code"][s])]
    assert {k: sorted(v) for k, v in got.items()} == want
    return want


def built(names, code, functions, relocations=(), symbols=None):
    """An object whose functions are text symbols; relocations: (section, slot, symbol or None, section or None)."""
    symbols = [(s, "text", 8 * a, 8 * n) for s, a, n in functions] if symbols is None else symbols
    moved = {(s, k): (symbols[sym][0], symbols[sym][2] // 8) if sym is not None else (to, 0) for s, k, sym, to in relocations}
    return {"names": names, "code": code, "functions": functions, "symbols": symbols, "relocations": [(s, 8 * k, "absolute", 32, sym, to) for s, k, sym, to in relocations], "moved": moved}


NAMES = {1: ".text", 2: "xdp", 3: "tc", 4: "license", 5: "maps"}


def test_by_hand(spark):
    text = [other(1), call(2), other(2), other(3), other(4), call(-4), other(5), other(6)]  # f at 0..2, g at 3..4, h at 5..7
    functions = [(1, 0, 3), (1, 3, 2), (1, 5, 3)]
    objects = {
        # calls h by a relocation, then f, then g again; f calls g
        "a": built(NAMES, {1: text, 2: [other(9), call(-1), call(-1), other(8), call(-1)], 3: [other(7)], 4: [other(0)]}, functions, [(2, 1, 2, None), (2, 2, 0, None), (2, 4, None, 1)]),
        "unknown function": built(NAMES, {1: text, 2: [call(77)]}, functions, [(2, 0, 0, None)]),
        "recursion": built(NAMES, {1: [call(-1), other(1)], 2: [call(-1)], 3: [other(3)]}, [(1, 0, 2)], [(2, 0, 0, None)]),
        "nested": built(NAMES, {1: [other(k) for k in range(9)], 2: [call(4), call(7)]}, [(1, 0, 9), (1, 3, 2)], [(2, 0, None, 1), (2, 1, None, 1)]),
        "no calls": built(NAMES, {2: [other(1), other(2)]}, []),
        "inside": built(NAMES, {2: [call(0), other(1)]}, []),
    }
    want = checked(spark, objects)
    assert len(want["a", 2]) == 5 + 3 + 3 + 2 and want["unknown function", 2][0][2] == "no function" and want["recursion", 2][0][2] == "recursion" and want["recursion", 3][0][2] is None


@pytest.mark.parametrize("seed", range(2))
def test_random_call_graphs(spark, seed):
    rng = random.Random(seed)
    objects = {}
    for n in range(12):
        sizes = [rng.randint(1, 6) for _ in range(rng.randint(1, 7))]
        starts = [sum(sizes[:k]) for k in range(len(sizes))]
        functions = [(1, a, b) for a, b in zip(starts, sizes, strict=True)]
        text = []
        for k, size in enumerate(sizes):
            for _ in range(size):
                later = range(k + 1, len(sizes)) if rng.random() < 0.97 else range(len(sizes))
                if rng.random() < 0.4 and len(later):
                    to = rng.choice(later)
                    text.append(call(rng.randint(starts[to], starts[to] + sizes[to] - 1) - len(text) - 1))
                else:
                    text.append(other(len(text)))
        code, relocations = {1: text}, []
        for s in (2, 3):
            code[s] = []
            for k in range(rng.randint(1, 8)):
                if rng.random() < 0.5:
                    to = rng.randrange(len(sizes))
                    code[s].append(call(-1))
                    relocations.append((s, k, to, None))
                else:
                    code[s].append(other(k))
        objects[f"o{n}"] = built(NAMES, code, functions, relocations)
    checked(spark, objects)


def test_misplaced_symbols_leave_sections_as_they_are(spark):
    x = built(NAMES, {1: [other(1), other(2)], 2: [call(-1), other(3)]}, [(1, 0, 2)], [(2, 0, 0, None)])
    x["symbols"] = [(1, "text", 4, 16), (1, "text", 0, 16)]
    rows = linking.loaded(*tables(spark, {"x": x})).collect()
    assert sorted((r.slot, tuple(r.insn), r.problem) for r in rows) == [(0, call(-1), "misplaced symbol"), (1, other(3), "misplaced symbol")]


def test_rounds_write_what_is_new_only(spark, monkeypatch):
    """A chain of functions: rows written in all rounds grow with its length, not with its square."""
    written, cut = [], linking.cut
    monkeypatch.setattr(linking, "cut", lambda df: written.append(cut(df)) or written[-1])
    n = 6
    edges = spark.createDataFrame([("o", 2, 0, 1, 0, 2), *(("o", 1, 2 * k, 1, 2 * k + 2, 2) for k in range(n - 1))], "object string, section int, slot long, to_section int, start long, count long")
    code = spark.createDataFrame([("o", 2, 0), *(("o", 1, k) for k in range(2 * n))], "object string, section int, slot long")
    pieces, problems = linking.layouts(spark.createDataFrame([("o", 2)], "object string, section int"), edges, code)
    assert sorted((r.section, r.start, r.loaded_at) for r in pieces.collect()) == [(1, 2 * k, 1 + 2 * k) for k in range(n)] + [(2, 0, 0)]
    assert problems.isEmpty() and sum(w.count() for w in written) <= 2 * (n + 1)  # a call and a piece each

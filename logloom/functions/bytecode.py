"""Column functions over binary instructions of eight bytes: opcode, registers, offset, immediate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let, named

# Fixed values of the instruction set: classes, operations, and opcodes of their own.
LD, LDX, ST, STX, ALU, JMP, JMP32, ALU64 = range(8)
JA, CALL, EXIT, MOV = 0x00, 0x80, 0x90, 0xB0
CALL_CODE, EXIT_CODE, LDIMM64 = 0x85, 0x95, 0x18
PSEUDO_CALL, PSEUDO_FUNC = 1, 4
# A call of a kernel instruction, and the move that carries its operands.
PSEUDO_KINSN, SIDECAR, MOVE_IMM, LOAD_WORD = 4, 3, 0xB7, 0x61
MAP_PSEUDO = {1: "fd", 2: "fd_value", 5: "idx", 6: "idx_value"}
# Where program types keep the packet's start and end in their context: (scope, type) -> (data, data_end).
PACKET_LAYOUTS = {
    ("packet", "xdp"): (0, 4),
    **{("packet", t): (76, 80) for t in ("sched_cls", "sched_act", "sk_skb", "lwt_in", "lwt_out", "lwt_xmit")},
    **{("helper", t): (76, 80) for t in ("sched_cls", "sched_act")},
}


def _signed(value: Column, bits: int) -> Column:
    return F.when(value >= 1 << (bits - 1), value - (1 << bits)).otherwise(value)


def decoded(raw: Column) -> Column:
    """(code, dst, src, off, imm) of eight little-endian bytes, read as one number; null for any other number of bytes."""
    turned = lambda h: F.concat(*(F.substring(h, 2 * k + 1, 2) for k in reversed(range(8))))
    field = lambda n, at, size: F.shiftright(n, at).bitwiseAND((1 << size) - 1).cast("int")
    fields = lambda n: named({"code": field(n, 0, 8), "dst": field(n, 8, 4), "src": field(n, 12, 4), "off": _signed(field(n, 16, 16), 16), "imm": F.shiftright(n, 32).cast("int")})
    number = let(F.hex(raw), lambda h: F.when(F.length(h) == 16, F.conv(turned(h), 16, -10).cast("long")))
    return let(number, lambda n: F.when(n.isNotNull(), fields(n)))


def kind(code: Column) -> Column:
    """The instruction's class, 0 to 7."""
    return code.bitwiseAND(7)


def operation(code: Column) -> Column:
    return code.bitwiseAND(0xF0)


def from_register(code: Column) -> Column:
    """Whether the second operand is a register."""
    return code.bitwiseAND(8) == 8


def is_jump_class(code: Column) -> Column:
    return kind(code).isin(JMP, JMP32)


def is_conditional(code: Column) -> Column:
    return is_jump_class(code) & ~operation(code).isin(JA, CALL, EXIT)


def is_jump(code: Column) -> Column:
    return is_jump_class(code) & (operation(code) == JA)


def is_call(code: Column) -> Column:
    return code == CALL_CODE


def is_exit(code: Column) -> Column:
    return code == EXIT_CODE


def is_pseudo_call(i: Column) -> Column:
    return is_call(i["code"]) & (i["src"] == PSEUDO_CALL)


def loads_function(i: Column) -> Column:
    return (i["code"] == LDIMM64) & (i["src"] == PSEUDO_FUNC)


def width(code: Column) -> Column:
    """Slots that an instruction takes."""
    return F.when(code == LDIMM64, 2).otherwise(1)


def branch_delta(i: Column) -> Column:
    """How far a jump goes: its immediate for 32-bit unconditional jumps, else its offset; null for others."""
    jumps = is_jump(i["code"]) | is_conditional(i["code"])
    return F.when(jumps, F.when((kind(i["code"]) == JMP32) & is_jump(i["code"]), i["imm"]).otherwise(i["off"]))


def branch_target(i: Column, pc: Column) -> Column:
    """The pc that a jump goes to; null below zero."""
    to = pc + 1 + branch_delta(i)
    return F.when(to >= 0, to)


def relative_target(i: Column, pc: Column) -> Column:
    """The pc that a call of a function of the program, or a reference to one, names."""
    to = pc + 1 + i["imm"]
    return F.when((is_pseudo_call(i) | loads_function(i)) & (to >= 0), to)


def map_pseudo(i: Column) -> Column:
    """How a wide load refers to a map."""
    return F.when(i["code"] == LDIMM64, F.create_map(*(F.lit(x) for p in MAP_PSEUDO.items() for x in p))[i["src"]])


def wide_value(low: Column, high: Column) -> Column:
    """The 64 bits of a wide load from its two immediates, as an unsigned number."""
    unsigned = lambda x: F.when(x < 0, x.cast("long") + (1 << 32)).otherwise(x.cast("long")).cast("decimal(20,0)")
    return (unsigned(low) + unsigned(high) * F.lit(1 << 32).cast("decimal(20,0)")).cast("decimal(20,0)")


def packet_layout(scope: Column, program_type: Column) -> Column:
    """(data, data_end): where a program type's context has the packet's bounds."""
    out = F.lit(None).cast("struct<data:int,data_end:int>")
    for (s, t), (a, b) in PACKET_LAYOUTS.items():
        out = F.when((scope == s) & (program_type == t), F.struct(F.lit(a).alias("data"), F.lit(b).alias("data_end"))).otherwise(out)
    return out


def uses(i: Column) -> Column:
    """Registers that an instruction reads."""
    code, k = i["code"], kind(i["code"])
    one = lambda c, r: F.when(c, F.array(r)).otherwise(F.array().cast("array<int>"))
    alu = k.isin(ALU, ALU64)
    dst = (alu & (operation(code) != MOV)) | k.isin(ST, STX) | is_conditional(code)
    src = (alu & from_register(code)) | k.isin(LDX, STX) | (is_jump_class(code) & ~is_call(code) & ~is_exit(code) & from_register(code))
    plain = F.array_distinct(F.concat(one(dst, i["dst"]), one(src, i["src"])))
    return F.sort_array(F.when(is_call(code), F.array(*(F.lit(r) for r in range(1, 6)))).when(is_exit(code), F.array(F.lit(0))).otherwise(plain))


def defs(i: Column) -> Column:
    """Registers that an instruction writes."""
    writes = kind(i["code"]).isin(ALU, ALU64, LDX, LD)
    return F.when(is_call(i["code"]), F.array(*(F.lit(r) for r in range(6)))).when(writes, F.array(i["dst"])).otherwise(F.array().cast("array<int>"))

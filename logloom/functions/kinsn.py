"""Kernel instructions called from programs: which registers a call reads and writes is packed into the move before it.

The payload has 4 bits of that move's destination, 16 of its offset and 32 of its immediate, from the lowest bit on. A descriptor is
rows of a dimension: for a role, where in the payload a register's number stands, and when it counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Targets by family, and for each family (role, bit of the register's number, mode that asks for it, flag bit that does).
TARGETS = {
    "x86_mov": ("bpf_x86_movb", "bpf_x86_movw", "bpf_x86_movl", "bpf_x86_movq", "bpf_x86_movzbl", "bpf_x86_movzwl", "bpf_x86_movswl", "bpf_x86_movsxd"),
    "arm64_mov": ("bpf_arm64_mov_x",),
    "x86_test": ("bpf_x86_testq",),
    "x86_cmov": ("bpf_x86_cmovneq", "bpf_x86_cmoveq"),
    "arm64_tst": ("bpf_arm64_tst",),
    "arm64_csel": ("bpf_arm64_csel_ne",),
    "lea": ("bpf_x86_leaq", "bpf_x86_leal"),
}
OPERANDS = {
    "x86_mov": (
        ("use", 8, 1, None), ("use", 8, 4, None), ("use", 8, 5, None), ("use", 12, 5, None), ("use", 4, 6, None), ("use", 8, 6, None), ("use", 4, 7, None),
        ("def", 4, 1, None), ("def", 4, 4, None), ("def", 4, 5, None),
    ),
    "arm64_mov": (("use", 4, None, None), ("def", 0, None, None)),
    "x86_test": (("use", 4, None, None),),
    "x86_cmov": (("use", 0, None, None), ("use", 4, None, None), ("use", 8, None, None), ("def", 0, None, None)),
    "arm64_tst": (("use", 0, None, None),),
    "arm64_csel": (("use", 4, None, None), ("use", 8, None, None), ("use", 12, None, None), ("def", 0, None, None)),
    "lea": (("use", 4, None, 15), ("use", 8, None, 14), ("def", 0, None, None)),
}


def payload(i: Column) -> Column:
    """What the move before a call carries, as a number of 52 bits."""
    off, imm = F.pmod(i["off"].cast("long"), F.lit(1 << 16)), F.pmod(i["imm"].cast("long"), F.lit(1 << 32))
    return i["dst"].cast("long").bitwiseOR(F.shiftleft(off, 4)).bitwiseOR(F.shiftleft(imm, 20))


def descriptors(spark: SparkSession) -> DataFrame:
    """(target, role, shift, mode, flag): a row for each operand of each target."""
    rows = [(t, *o) for family, targets in TARGETS.items() for t in targets for o in OPERANDS[family]]
    return spark.createDataFrame(rows, "target string, role string, shift int, mode int, flag int")


def register(p: Column, shift: Column) -> Column:
    """The register's number that begins at a bit of the payload."""
    return F.pmod(_above(p, shift), F.lit(16)).cast("int")


def _above(p: Column, bit: Column) -> Column:
    """The payload without its bits below one; 52 bits are exact as a double."""
    return F.floor(p / F.pow(F.lit(2), bit))


def applies(p: Column, mode: Column, flag: Column) -> Column:
    """Whether an operand counts for this payload: its mode is the payload's, its flag is set."""
    in_mode = mode.isNull() | (F.pmod(p, F.lit(16)) == mode)
    flagged = flag.isNull() | (F.pmod(_above(p, flag), F.lit(2)) == 1)
    return in_mode & flagged

"""Column functions over single lines of a rejection log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .instructions import is_instruction, pc_prefix

_DAY, _TIME = r"\d{4}-\d{2}-\d{2}", r"\d{2}:\d{2}:\d{2}"
ANSI = r"\x1b\[[^@-~]*[@-~]"
STAMPS = rf"^(?:\s*(?:\[{_DAY}[Tt ]{_TIME}[^\]]*\]|{_DAY}[Tt]{_TIME}\S*\s))*\s*"
SOURCE_COMMENT = r"^(?:;\s*)?(.*) @ (.*):(\d+)\s*$"
BEGIN_MARK, END_MARK = "-- BEGIN PROG LOAD LOG --", "-- END PROG LOAD LOG --"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# What a line must contain, in lower case, to report an error.
ERROR_MARKERS = (
    "bpf program is too large", "combined stack size", "invalid ", "unbounded", "out of bounds", "outside of", "expected ", "expected=",
    "possibly null pointer passed to", "misaligned", "missing btf", "unknown opcode", "unknown func", "arg#", "unreleased reference",
    "reference has not", "unacquired reference", "helper call is not allowed", "helper access to the packet is not allowed",
    "cannot use helper", "calling kernel function", "kernel subsystem misconfigured verifier", "jit does not support", "cannot ",
    "permission denied", "does not allow writes to packet data", "too many states", "processed 1000001", "loop is not bounded",
    "infinite loop detected", "back-edge", "same insn cannot be used with different pointers", "pointer arithmetic", "bitwise operator",
    "should have been in", "cannot restore irq", "may sleep", "non-sleepable", "rcu", "lock", "kfunc", "trusted", "iter",
    "min value is negative", "min value is outside", "dereference of modified ctx ptr", "makes pkt pointer", "type=", "!read_ok",
    "only read from", "access beyond struct", "has no valid kptr", "must be a known constant", "dynptr",
)
# How a line may not start if it reports an error.
NOT_ERRORS = ("libbpf:", "Error:", "-- END", "verification time ", "stack depth ", "mark_precise:", ";")
CONTROL_STARTS = ("::group::", "::endgroup::", "##[group]", "##[endgroup]")


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def ascii_lower(c: Column) -> Column:
    """Lower case of A to Z only. Full lower-casing is much faster, and differs in what ASCII searches see only where one of two
    letters beyond ASCII turns into an ASCII one."""
    odd = c.contains("\u212a") | c.contains("\u0130")
    return F.when(odd, F.translate(c, ASCII_UPPER, ASCII_LOWER)).otherwise(F.lower(c))


def strip_ansi(line: Column) -> Column:
    return F.regexp_replace(line, ANSI, "")


def strip_timestamps(line: Column) -> Column:
    """Drops leading white space and ISO-8601 stamps, in brackets or as the first token, as often as they repeat."""
    return F.regexp_replace(line, STAMPS, "")


def normalized(line: Column) -> Column:
    """The line without colour codes, trailing carriage returns, leading stamps and white space."""
    return strip_timestamps(F.regexp_replace(strip_ansi(line), r"\r+$", ""))


def is_control(line: Column) -> Column:
    return any_of(line.startswith(s) for s in CONTROL_STARTS)


def is_state(line: Column) -> Column:
    """`from A to B: ...`, or a state after the first colon."""
    return line.startswith("from ") | line.rlike(r"^[^:]*:\s*(?:R|frame)")


def is_error(line: Column) -> Column:
    """A trimmed line that reports an error. Plain searches for the markers are faster than an alternation; most lines are instructions
    or states, and those are never searched."""

    def reports(x: Column) -> Column:
        refused = any_of(x.startswith(s) for s in NOT_ERRORS) | (x.startswith("processed ") & ~x.contains("1000001"))
        marked = let(ascii_lower(x), lambda low: any_of(low.contains(m) for m in ERROR_MARKERS))
        return (x != "") & ~refused & ~is_instruction(x) & ~is_state(x) & marked

    return let(line, reports)


def is_boundary(line: Column, error: Column | None = None) -> Column:
    """Separates fragments of a log: what comes before does not describe the same run of instructions. `error`: whether the line
    reports one, where that is known already."""
    marks = line.startswith("func#") | line.contains(BEGIN_MARK) | line.contains(END_MARK)
    return marks | any_of(line.startswith(s) for s in ("processed ", "verification time ", "stack depth ")) | (~is_instruction(line) & (is_error(line) if error is None else error))


def is_region_start(line: Column) -> Column:
    starts = any_of(line.startswith(s) for s in ("func#", "from ", "Validating "))
    return starts | (line == "Live regs before insn:") | line.rlike(SOURCE_COMMENT) | pc_prefix(line).isNotNull()


def source_comment(line: Column) -> Column:
    """(text, path, line) of `; text @ path:line`, split at the last such mark; null for other lines."""
    parts = [F.regexp_extract(line, SOURCE_COMMENT, k) for k in (1, 2, 3)]
    found = F.struct(F.trim(parts[0]).alias("text"), parts[1].alias("path"), parts[2].try_cast("int").alias("line"))
    return F.when(line.rlike(SOURCE_COMMENT), found)

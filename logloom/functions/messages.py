"""Column functions over terminal messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .instructions import _found
from .lines import ascii_lower

STACK_READ = r"(?:^|[;\s])invalid\s+read\s+from\s+stack\s+(?:R(\d+)\s+)?off\s+([+-]?\d+)([+-]\d+)?\s+size\s+(\d+)(?=[;\s]|$)"
I16 = (-(1 << 15), (1 << 15) - 1)
# The words before the name of a helper, the first that a message has in this order.
HELPER_MARKS = ("cannot use helper ", "helper call ", "unknown func ", "into func ")


def signed_after(c: Column, mark: str) -> Column:
    """The number, decimal or hexadecimal, after the first word that is `mark` with a number; null beyond 64 bits."""
    return let(_found(c, rf"(?:^|[^A-Za-z0-9_]){mark}([+-]?(?:0[xX][0-9A-Fa-f]+|[0-9]+))", 1), _marked)


def _marked(text: Column) -> Column:
    digits = F.regexp_replace(text, "^[+-]?0[xX]", "")
    value = F.when(digits.rlike("^0*[0-7]?[0-9A-Fa-f]{1,15}$"), F.conv(digits, 16, 10).try_cast("long"))
    return F.when(text.rlike("^[+-]?0[xX]"), F.when(text.startswith("-"), -value).otherwise(value)).otherwise(text.try_cast("long"))


def natural_after(c: Column, mark: str) -> Column:
    """As `signed_after`, of 32-bit numbers without a minus."""
    return let(signed_after(c, mark), lambda value: F.when(value.between(0, (1 << 32) - 1), value))


def has_any(message: Column, *parts: str) -> Column:
    """Whether the message contains one of the parts, whatever the case of ASCII letters."""
    low = ascii_lower(message)
    return reduce(lambda a, b: a | b, (low.contains(p) for p in parts))


def has(message: Column, *parts: str) -> Column:
    """Whether the message contains all parts, whatever the case of ASCII letters."""
    low = ascii_lower(message)
    return reduce(lambda a, b: a & b, (low.contains(p) for p in parts))


# ---- what kind of message it is ----


def is_scalar_access(message: Column) -> Column:
    return has_any(message, "invalid mem access 'scalar'", "invalid mem access 'inv'")


def names_packet_end(message: Column) -> Column:
    return has_any(message, "pkt_end", "ptr_to_packet_end")


def is_pointer_arithmetic(message: Column) -> Column:
    return has_any(message, "pointer arithmetic")


def is_pointer_arithmetic_or_bitwise(message: Column) -> Column:
    return has_any(message, "pointer arithmetic", "bitwise operator")


def is_context_access(message: Column) -> Column:
    return has_any(message, "invalid bpf_context access", "invalid ctx access", "invalid access to context")


# ---- registers, arguments, helpers ----


def register(message: Column) -> Column:
    return _found(message, r"R(\d+)", 1).try_cast("int")


def argument(message: Column) -> Column:
    """The number after `arg #`, `arg#` or `arg `."""
    return F.coalesce(*(natural_after(message, m).try_cast("int") for m in ("arg #", "arg#", "arg ")))


def zero_based_argument(message: Column, mark: str) -> Column:
    """The number of a call's argument counted from zero, of five at most."""
    return let(natural_after(message, mark).try_cast("int"), lambda n: F.when(n < 5, n))


def register_of_argument(n: Column) -> Column:
    """The register that passes an argument counted from zero: r1 to r5."""
    return let(n, lambda x: F.when((x >= 0) & (x < 5), x + 1))


def argument_register_after(message: Column, mark: str) -> Column:
    return register_of_argument(zero_based_argument(message, mark))


def argument_register(message: Column) -> Column:
    return register_of_argument(argument(message))


def helper(message: Column) -> Column:
    """The word behind the first of the marks that the message has, without signs at its ends; it may end in `#` and a number."""
    words = (F.nullif(F.regexp_replace(_found(message, rf"{m}\s*(\S+)", 1), "^[:,;]+|[:,;]+$", ""), F.lit("")) for m in HELPER_MARKS)
    return F.coalesce(*words)


def called_function(message: Column) -> Column:
    """The name in the last ('name')."""
    return _found(message, r"^.*\('([^']*)'\)", 1)


# ---- ranges ----


def _range(start: Column, size: Column) -> Column:
    """[start, end) of 16-bit numbers; null beyond or backwards."""
    end = start + size
    return F.when(start.between(*I16) & end.between(*I16) & (size >= 0), F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))


def stack_read(message: Column) -> Column:
    """(register, base, delta, size, start, end) of the bytes that a stack read failed at; null for other messages."""
    reg, base, off, size = (_found(message, STACK_READ, k).try_cast("int") for k in (1, 2, 3, 4))
    read = F.struct(reg.alias("register"), base.alias("base"), F.coalesce(off, F.lit(0)).alias("delta"), size.alias("size"))
    span = lambda r: _range(F.try_add(r["base"], r["delta"]), r["size"])
    return F.when(message.rlike(STACK_READ), let(read, lambda r: F.when(r["size"].isNotNull(), F.struct(*(r[c].alias(c) for c in ("register", "base", "delta", "size")), span(r)["start"].alias("start"), span(r)["end"].alias("end")))))


def stack_write(message: Column) -> Column:
    """(start, end) of the bytes that a stack write failed at."""
    of = lambda name: F.coalesce(signed_after(message, f"{name}="), signed_after(message, f"{name} "))
    within = lambda x: F.when(x.between(*I16), x)
    return F.when(has(message, "invalid write to stack"), let(F.struct(of("off").alias("off"), of("size").alias("size")), lambda w: _range(within(w["off"]), within(w["size"]))))


def map_value_access(message: Column) -> Column:
    """(value_size, off, size), all of them or null."""
    access = F.struct(natural_after(message, "value_size=").alias("value_size"), signed_after(message, "off=").alias("off"), natural_after(message, "size=").alias("size"))
    return F.when(has(message, "invalid access to map value"), let(access, lambda a: F.when(a["value_size"].isNotNull() & a["off"].isNotNull() & a["size"].isNotNull(), a)))


def ends_behind_value(access: Column) -> Column:
    return F.coalesce(F.try_add(access["off"], access["size"]) > access["value_size"], F.lit(False))


def wider_than_value(access: Column) -> Column:
    return F.coalesce(access["size"] > access["value_size"], F.lit(False))


def required_return_range(message: Column) -> Column:
    pattern = r"should have been in \[\s*([+-]?\d+)\s*,\s*([+-]?\d+)\s*\]"
    lo, hi = (_found(message, pattern, k).try_cast("long") for k in (1, 2))
    return F.when(lo.isNotNull() & hi.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi")))


def packet_required(message: Column) -> Column:
    """Bytes of a packet that an access needs: offset and size."""
    return let(F.try_add(signed_after(message, "off="), signed_after(message, "size=")), lambda need: F.when(need.between(0, (1 << 32) - 1), need))


def explicit_pc(message: Column) -> Column:
    return _found(message, r"^insn (\d+)", 1).try_cast("int")


def in_stack_frame(span: Column) -> Column:
    """Whether bytes [start, end) lie in the 512 bytes below the frame pointer."""
    return (span["start"] >= -512) & (span["end"] <= 0)

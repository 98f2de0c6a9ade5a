"""Column functions over register states with value ranges: structs with reg_type, narrow (a 32-bit value), exact, tnum_value and
the nullable bounds smin, smax, umin, umax, smin32, smax32, umin32 and umax32; for map values also off and map_value_size.
Unsigned 64-bit numbers are decimal(20,0)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUNDS = ("smin", "smax", "umin", "umax", "smin32", "smax32", "umin32", "umax32")
I32_MAX = (1 << 31) - 1
I64_MAX = (1 << 63) - 1
U64, U32 = "decimal(20,0)", 4294967296


def _is(condition: Column) -> Column:
    """A condition that an unknown number does not meet."""
    return F.coalesce(condition, F.lit(False))


def _any(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def as_signed(unsigned: Column) -> Column:
    """An unsigned 64-bit number read as a signed one."""
    wide = unsigned.cast("decimal(21,0)")
    return F.when(unsigned > I64_MAX, wide - F.lit("18446744073709551616").cast("decimal(21,0)")).otherwise(wide).try_cast("long")


def as_signed32(unsigned: Column) -> Column:
    return F.when(unsigned > I32_MAX, unsigned - U32).otherwise(unsigned)


def lowest(r: Column) -> Column:
    """The first known of the lower bounds, signed before unsigned, wide before narrow."""
    return F.coalesce(r["smin"], r["umin"].try_cast("long"), r["smin32"].cast("long"), r["umin32"].cast("long"))


def highest(r: Column) -> Column:
    return F.coalesce(r["smax"], r["umax"].try_cast("long"), r["smax32"].cast("long"), r["umax32"].cast("long"))


def bounded(r: Column) -> Column:
    return _any(*(r[b].isNotNull() for b in BOUNDS))


def variable_offset(r: Column) -> Column:
    """Whether known bits or any bound say that an offset varies."""
    return r["tnum_value"].isNotNull() | bounded(r)


def same(a: Column, b: Column) -> Column:
    return reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in BOUNDS))


# ---- exact values ----


def exact_u64(r: Column) -> Column:
    """The exact value of a scalar that is not known for its low 32 bits only."""
    return F.when((r["reg_type"] == "scalar") & ~_is(r["narrow"]), r["exact"])


def exact_u32(r: Column) -> Column:
    return F.when(r["reg_type"] == "scalar", (r["exact"] % U32).cast("long"))


def exact_scalar(r: Column) -> Column:
    return F.coalesce(exact_u64(r), exact_u32(r).cast(U64))


def is_zero(r: Column) -> Column:
    return _is(exact_scalar(r) == 0)


# ---- predicates; a missing bound leaves a value unsafe ----


def may_be_negative(r: Column) -> Column:
    return F.when(r["exact"].isNotNull(), r["exact"] > I64_MAX).when(r["smin"].isNotNull(), r["smin"] < 0).otherwise(r["umin"].isNull())


def may_include_zero(r: Column) -> Column:
    return F.when(r["exact"].isNotNull(), r["exact"] == 0).otherwise(~_any(_is(r["smax"] < 0), _is(r["smin"] > 0), _is(r["umin"] > 0)))


def too_large(r: Column) -> Column:
    """A 64-bit upper bound, of either kind, beyond 31 bits, or none of them."""
    return _any(_is(r["smax"] > I32_MAX), _is(r["umax"] > I32_MAX), r["smax"].isNull() & r["umax"].isNull())


def unsafe(r: Column) -> Column:
    return _any(r["smin"].isNull(), _is(r["smin"] < 0), r["umin"].isNull(), r["umax"].isNull(), _is(r["umax"] > I32_MAX))


def outside(r: Column, lo: Column, hi: Column) -> Column:
    """Whether a scalar's known bounds leave the required range, or none of the views that can tell is complete.

    Views, the first complete one decides: exact value, exact low half, signed, unsigned, signed and unsigned 32-bit bounds;
    unsigned ones only for a range without negative numbers."""
    natural = (lo >= 0) & (hi >= 0)
    within = lambda v: (v >= lo) & (v <= hi)
    wide, narrow = exact_u64(r), exact_u32(r)
    both = lambda a, b: r[a].isNotNull() & r[b].isNotNull()
    leaves = lambda a, b: (r[a] < lo) | (r[b] > hi)
    found = (
        F.when(wide.isNotNull(), ~within(as_signed(wide)) & (~natural | ~within(wide)))
        .when(narrow.isNotNull(), ~within(as_signed32(narrow)) & (~natural | ~within(narrow)))
        .when(both("smin", "smax"), leaves("smin", "smax"))
        .when(natural & both("umin", "umax"), leaves("umin", "umax"))
        .when(both("smin32", "smax32"), leaves("smin32", "smax32"))
        .when(natural & both("umin32", "umax32"), leaves("umin32", "umax32"))
        .otherwise(True)
    )
    return (r["reg_type"] == "scalar") & found


def at_most(r: Column, cap: Column) -> Column:
    """Whether a scalar's exact value or any known upper bound is within the cap; a negative signed bound is none."""
    signed = (_is((r[b] >= 0) & (r[b] <= cap)) for b in ("smax", "smax32"))
    return (r["reg_type"] == "scalar") & _any(*(_is(r[b] <= cap) for b in ("exact", "umax", "umax32")), *signed)


# ---- map values ----


def remaining(value_size: Column, offset: Column) -> Column:
    """Bytes of a map value behind a constant offset (0 if unknown); null for negative offsets or none left."""
    off = F.coalesce(offset, F.lit(0))
    left = F.try_subtract(value_size, off)
    return F.when((off >= 0) & (left >= 0), left)


def variable_offset_max(r: Column) -> Column:
    return F.coalesce(r["umax"], F.when(r["smax"] >= 0, r["smax"].cast(U64)))


def _largest_offset(r: Column) -> Column:
    fixed, variable = F.when(r["off"] >= 0, r["off"].cast(U64)), variable_offset_max(r)
    return F.coalesce((fixed.cast("decimal(21,0)") + variable).try_cast(U64), F.when(fixed.isNull() | variable.isNull(), F.coalesce(fixed, variable)))


def access_may_exceed(r: Column, size: Column) -> Column:
    """Whether an access of this size at the largest offset of a map value ends behind it; an unknown offset counts as 0."""
    end = F.coalesce(_largest_offset(r), F.when(F.coalesce(r["off"] < 0, F.lit(True)) & variable_offset_max(r).isNull(), F.lit(0).cast(U64))) + size
    return _is((r["reg_type"] == "map_value") & (end > r["map_value_size"]))


def offset_may_exceed(r: Column) -> Column:
    """Whether the largest offset of a map value is behind its last byte."""
    return _is((r["reg_type"] == "map_value") & (_largest_offset(r) >= r["map_value_size"]))


def unsafe_state(r: Column) -> Column:
    """What a bounds diagnosis looks for: an unsafe scalar, or a map value whose offset may leave it."""
    return (_is(r["reg_type"] == "scalar") & unsafe(r)) | offset_may_exceed(r)


def pointer_like(r: Column) -> Column:
    return ~r["reg_type"].isin("scalar", "fp")


# ---- texts ----


def _parts(r: Column) -> Column:
    return F.concat_ws(",", *(F.when(r[b].isNotNull(), F.concat(F.lit(f"{b}="), r[b].cast("string"))) for b in BOUNDS[:4]))


def summary(r: Column) -> Column:
    """A scalar's value or its 64-bit bounds as text."""
    bounds = _parts(r)
    return F.when(r["exact"].isNotNull(), F.concat(F.lit("scalar exact "), r["exact"].cast("string"))).when(bounds == "", "scalar with unknown bounds").otherwise(F.concat(F.lit("scalar("), bounds, F.lit(")")))


def value_summary(r: Column) -> Column:
    """A register's value as text: a scalar's summary, or type, offset, value size and bounds."""
    bounds = _parts(r)
    parts = F.concat_ws(",", F.concat(F.lit("off="), r["off"].cast("string")), F.concat(F.lit("value_size="), r["map_value_size"].cast("string")), F.when(bounds != "", F.concat(F.lit("range("), bounds, F.lit(")"))))
    return F.when(r["reg_type"] == "scalar", summary(r)).when(parts == "", r["reg_type"]).otherwise(F.concat(r["reg_type"], F.lit("("), parts, F.lit(")")))

"""Column functions over lines of source code that logs quote: what a line looks like, its arguments, numbers and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .instructions import _found
from .lines import ascii_lower

# Words that are no names of values.
NO_NAMES = ("if", "void", "char", "unsigned", "int", "__u8", "__u16", "__u32", "__u64", "data", "data_end", "byte")
# Calls whose result may be null, that acquire and that release a reference.
NULLABLE_CALLS = ("bpf_map_lookup_elem", "bpf_ringbuf_reserve", "bpf_sk_lookup", "bpf_skc_lookup")
ACQUIRING_CALLS = ("bpf_ringbuf_reserve", "bpf_sk_lookup", "bpf_skc_lookup")
RELEASING_CALLS = ("bpf_ringbuf_discard", "bpf_ringbuf_submit", "bpf_sk_release")
NULL_MARKS = ("null", "!tmp", "!val", "!ptr", "!value", "== 0", "!= 0")
MAP_SECTIONS = ('sec(".maps")', 'sec("maps")', '__section(".maps")', '__section("maps")')


def _any_of(text: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(p) for p in parts))


def is_scalar_guard(text: Column) -> Column:
    return text.startswith("if ") & _any_of(text, ("<", ">", "!=", "=="))


def is_packet_check(text: Column) -> Column:
    return text.startswith("if ") & text.contains("data_end")


def is_null_check(text: Column) -> Column:
    low = ascii_lower(text)
    return low.startswith("if ") & _any_of(low, NULL_MARKS)


def is_nullable_return(text: Column) -> Column:
    return _any_of(text, NULLABLE_CALLS)


def is_stack_initialization(text: Column) -> Column:
    return text.contains("=") & _any_of(text, ("0", "memset"))


def is_acquire(text: Column) -> Column:
    return _any_of(text, ACQUIRING_CALLS)


def is_release(text: Column) -> Column:
    return _any_of(text, RELEASING_CALLS)


def is_packet_derivation(text: Column) -> Column:
    """`type *p = data + n`: a pointer made by an addition."""
    t = F.trim(text)
    return ~t.startswith("if ") & t.contains("+") & F.substring_index(t, "=", 1).contains("*") & t.contains("=")


def call_argument(text: Column, function: str, index: int) -> Column:
    """The argument of a call (counted from 0) outside inner brackets; null if the first mention is no call or has fewer.

    Brackets are followed four deep."""
    inner = r"[^(),]"
    for _ in range(4):
        inner = rf"(?:[^(),]|\((?:{inner}|,)*\))"
    first = F.substring_index(text, function, 1)
    after = F.substring(text, F.length(first) + len(function) + 1, 1 << 20)
    found = F.regexp_extract(after, rf"^\((?:{inner}*,){{{index}}}({inner}*)[,)]", 1)
    return F.when(text.contains(function) & after.rlike(rf"^\((?:{inner}*,){{{index}}}{inner}*[,)]"), F.trim(found))


def is_bare_identifier(argument: Column) -> Column:
    return F.trim(argument).rlike(r"^[A-Za-z_][A-Za-z0-9_]*$")


def numbers(text: Column) -> Column:
    """All runs of digits that fit in 32 bits."""
    found = F.transform(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("long"))
    return F.filter(found, lambda x: x < (1 << 32))


def largest_number(text: Column) -> Column:
    return F.array_max(numbers(text))


def identifiers(text: Column) -> Column:
    """Names in order: words of two letters and more, or i, j, k, without numbers and words of the language."""
    words = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]+"), F.lit(0))
    return F.filter(words, lambda w: ((F.length(w) >= 2) | w.isin("i", "j", "k")) & ~w.rlike("^[0-9]") & ~w.isin(*NO_NAMES))


def is_literal_null(argument: Column) -> Column:
    compact = ascii_lower(F.regexp_replace(argument, r"\s", ""))
    cast = compact.startswith("(") & compact.rlike(r"\)(?:0|null)$") & compact.contains("*")
    return compact.isin("null", "(void*)null", "(void*)0") | compact.rlike("^0[ul]*$") | cast


def addressed_name(argument: Column) -> Column:
    """The name behind the last `&`, if nothing but a cast stands before it and nothing behind it."""
    return _found(argument, r"^(?:\s*|.*\)\s*)&\s*([A-Za-z0-9_]+)\s*$", 1)


def declares_map(text: Column, name: Column) -> Column:
    """Whether a line declares a map of this name."""
    compact = ascii_lower(F.regexp_replace(text, r"\s", ""))
    return F.array_contains(identifiers(text), name) & _any_of(compact, MAP_SECTIONS)


def lost_relocation(argument: Column) -> Column:
    """The mark of sources that were put together again after their relocation was lost."""
    return F.array_contains(identifiers(argument), "missing_relocation")


def guarded_pointer(text: Column) -> Column:
    """The first name before `> data_end` in a condition."""
    condition = F.regexp_replace(_found(F.trim(text), r"^if (.*)$", 1), r"^\s*\((.*)\)\s*$", "$1")
    before = F.when(condition.contains("> data_end"), F.substring_index(condition, "> data_end", 1)).when(condition.contains(">= data_end"), F.substring_index(condition, ">= data_end", 1))
    return F.get(identifiers(before), F.lit(0))


def assigned_name(text: Column) -> Column:
    """The last name left of the first equals sign."""
    return F.when(text.contains("="), F.try_element_at(identifiers(F.substring_index(text, "=", 1)), F.lit(-1)))


def upper_bound(text: Column, name: Column) -> Column:
    """The least number that the clauses of a condition with this name are compared with; null without any."""
    clauses = F.filter(F.split(text, "&&"), lambda c: F.array_contains(identifiers(c), name) & c.rlike("<"))
    return F.array_min(F.transform(clauses, lambda c: F.array_max(numbers(c))))


def guard_bound(text: Column, name: Column) -> Column:
    """The least value that a condition's clauses (joined by &&) leave to a name: from `name < n`, `name <= n`, `n > name`, `n >= name`."""
    condition = F.regexp_replace(F.trim(F.regexp_replace(F.trim(text), "^if", "")), r"^\((.*)\)$", "$1")

    def bound(clause: Column) -> Column:
        sides = lambda op: F.transform(F.split(clause, op, 2), lambda x: F.regexp_replace(x, r"^[\s(]+|[\s)]+$", ""))
        number = lambda c: F.when(c.rlike("^[0-9]+[uUlL]*$"), _found(c, "^([0-9]+)", 1).try_cast("long"))
        op = F.regexp_extract(clause, "(<=|>=|<|>)", 1)
        two = F.when(op == "<=", sides("<=")).when(op == ">=", sides(">=")).when(op == "<", sides("<")).when(op == ">", sides(">"))
        left, right = F.get(two, F.lit(0)), F.get(two, F.lit(1))
        above = F.when(left == name, F.when(op == "<", number(right) - 1).when(op == "<=", number(right)))
        return F.coalesce(above, F.when((right == name) & (left != name), F.when(op == ">", number(left) - 1).when(op == ">=", number(left))))

    return F.array_min(F.filter(F.transform(F.split(condition, "&&"), bound), lambda x: x.isNotNull()))

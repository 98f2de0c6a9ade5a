"""Column functions that parse lines of abstract machine states.

`PC: R1=scalar(umax=255,var_off=(0x0; 0xff)) R10=fp0 fp-8=mmmmmmmm refs=2`, behind `from A to B` or after an instruction and a
semicolon. Where brackets balance and nest eight deep at most, as nearly always, regular expressions find what stands at the top level;
other texts take a scan that carries the depth of brackets from piece to piece. No Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let, named, through
from .instructions import _found

#: How deep brackets may nest for regular expressions, which grow by one line for each level.
DEEP = 8


def _brackets(deep: int) -> str:
    """Brackets that balance and nest so deep at most. Possessive, so that each character is read once, whatever comes behind."""
    inner = "[^()]*+" if deep == 1 else rf"(?:[^()]++|{_brackets(deep - 1)})*+"
    return rf"\({inner}\)"


_NESTED = _brackets(DEEP)
TOKEN = rf"(?:[^\s()]++|{_NESTED})++"
FROM = r"^from\s*(\d+)\s* to (\d+)( \(speculative execution\))?:\s*(.*)$"
PLAIN = r"^\s*(\d+)\s*:\s*(.*)$"
DELTA = rf"^((?:[^;()]++|{_NESTED})*+);\s*(.*)$"
TEXT = r"^(?:R|frame|fp-|refs=|(?:async_)?cb$)"
LOOKS = r"^from .*(?: R|: R|frame)|^\s*\d*\s*:\s*(?:[^;]*;\s*)?(?:R|frame|fp-|refs=|(?:async_)?cb\s*$)"
REGISTER = r"^R(\d+)(_w)?=(.*)$"
SLOT = r"^fp([+-]?\d+)(?:_[rw]+)?=(.*)$"
SLOT_TYPES = "[?rm0dif]"
NUMBER = r"^([+-]?(?:0[xX][0-9a-fA-F]+|\d+))$"
FRAME_POINTER = r"^fp(?:\[(\d+)\])?([+-]?(?:0[xX][0-9a-fA-F]+|\d+))?$"
TYPED = r"^([^(]*)\((.*)\)[^)]*$"
#: One `name=` of a chain `a=b=value`, with the chain's value.
ATTRIBUTE = r"(\w+?)(?:_value)?=(?=(?:\w+=)*((?:\([^()]*\)|[^,()=])*)(?:,|$))"
U64 = "decimal(20,0)"
#: Texts whose brackets balance and nest eight deep at most, and one deep.
SHALLOW = rf"^(?:[^()]++|{_NESTED})*+$"
FLAT = rf"^(?:[^()]++|{_brackets(1)})*+$"


# ---- brackets ----


def top_level(text: Column, separator: str) -> Column:
    """The parts of a text between separators (a pattern) that stand outside brackets, as they are.

    Brackets may nest as deep as they like and need not balance: a closing one too many makes the depth negative, and what follows is
    outside no more until it is made up for. The text is cut at its brackets, and one aggregate carries the depth and the open part."""
    start = named({"depth": F.lit(0), "done": F.array().cast("array<string>"), "open": F.lit("")})
    pieces = F.split(text, r"(?<=[()])|(?=[()])")

    def step(a: Column, piece: Column) -> Column:
        depth = a["depth"] + F.when(piece == "(", 1).when(piece == ")", -1).otherwise(0)

        def cut(parts: Column) -> Column:
            splits = F.size(parts) > 1
            done = F.when(splits, F.concat(a["done"], F.array(F.concat(a["open"], parts[0])), F.slice(parts, 2, F.size(parts) - 2))).otherwise(a["done"])
            return named({"depth": depth, "done": done, "open": F.when(splits, F.element_at(parts, -1)).otherwise(F.concat(a["open"], piece))})

        return let(F.when(a["depth"] == 0, F.split(piece, separator)).otherwise(F.array(piece)), cut)

    return F.aggregate(pieces, start, step, lambda a: F.concat(a["done"], F.array(a["open"])))


def top_level_tokens(text: Column) -> Column:
    """Parts between white space outside brackets. A closing bracket never begins one."""
    spaced = F.transform(top_level(text, r"\s+"), lambda x: F.regexp_replace(x, r"^\)+", ""))
    deep = F.filter(spaced, lambda x: x != "")
    return F.when(text.rlike(SHALLOW), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).otherwise(deep)


def top_level_segments(text: Column, separator: str) -> Column:
    """Parts between a separator outside brackets, trimmed, without empty ones."""
    return F.filter(F.transform(top_level(text, rf"\Q{separator}\E"), lambda x: F.trim(x)), lambda x: x != "")


def behind_top_level(text: Column, separator: str) -> Column:
    """What follows the first separator outside brackets; null without one."""
    parts = top_level(text, rf"\Q{separator}\E")
    return let(parts, lambda p: F.when(F.size(p) > 1, F.substring(text, F.length(p[0]) + len(separator) + 1, F.length(text))))


def state(line: Column) -> Column:
    """(pc, from_pc, kind, speculative, frame, tokens) of a state line; null for others.

    Kinds: edge_full, pc_full, branch_delta, insn_delta. A line without any register, slot, reference or callback is none."""
    return let(F.trim(line), _state)


def _state(t: Column) -> Column:
    return through({"line": t}, forms, parts, lambda x: let(kind_text(x), lambda text: F.when(text.isNotNull(), named(fields({n: x[n] for n in ("line", "edge", "is_from", "is_full", "insn")} | {"text": text})))))


def forms(x) -> dict:
    """What stands behind the edge, or behind the pc, of a trimmed line."""
    t = x["line"]
    return {"edge": F.when(t.startswith("from "), F.regexp_extract(t, FROM, 4)), "after": F.when(t.rlike(r"^\d+\s*:"), F.regexp_extract(t, PLAIN, 2))}


def parts(x) -> dict:
    """Which of the two is a state; the text behind an instruction, and the instruction."""
    after = x["after"]
    delta = F.when(after.contains(";"), F.trim(F.when(after.rlike(SHALLOW), F.regexp_extract(after, DELTA, 2)).otherwise(F.coalesce(behind_top_level(after, ";"), F.lit("")))))
    return {"is_from": F.coalesce(x["edge"].rlike(TEXT), F.lit(False)), "is_full": F.coalesce(after.rlike(TEXT), F.lit(False)), "delta": delta, "insn": F.substring_index(after, ";", 1)}


def kind_text(x) -> Column:
    """The text of the state; null without one."""
    return F.when(x["is_from"], x["edge"]).when(x["is_full"], x["after"]).when(x["delta"].rlike(TEXT), x["delta"])


def fields(x) -> dict:
    t, text, is_from = x["line"], x["text"], x["is_from"]
    kind = F.when(is_from, "edge_full").when(x["is_full"], "pc_full").when(x["insn"].contains(" if ") & x["insn"].contains(" goto "), "branch_delta").otherwise("insn_delta")
    framed = text.startswith("frame")
    frame = F.coalesce(F.when(framed, _found(text, r"^frame(\d+)\s*:", 1).try_cast("int")), F.lit(0))
    tokens = let(F.when(framed, F.regexp_replace(text, r"^frame\d+\s*:\s*", "")).otherwise(text), top_level_tokens)
    pc = F.when(is_from, _found(t, FROM, 2)).otherwise(F.trim(F.substring_index(t, ":", 1))).try_cast("int")
    return {"pc": pc, "from_pc": F.when(is_from, _found(t, FROM, 1).try_cast("int")), "kind": kind, "speculative": is_from & t.contains(" (speculative execution):"), "frame": frame, "tokens": tokens}


def malformed(line: Column) -> Column:
    """Whether a line looks like a state and is none, or has nothing that a state could hold."""

    def check(t: Column) -> Column:
        found = _state(t)
        empty = ~F.exists(found["tokens"], lambda x: holds(x))
        return F.coalesce(F.when(found.isNull(), t.rlike(LOOKS) & t.contains(":")).otherwise(empty), F.lit(False))

    return let(F.trim(line), check)


def holds(token: Column) -> Column:
    """Whether a token is a register or slot with a valid value, a callback mark or a count of references."""
    register = token.rlike(REGISTER) & _valid(F.regexp_extract(token, REGISTER, 3))
    slot = token.rlike(SLOT) & _valid(F.regexp_replace(F.regexp_extract(token, SLOT, 2), rf"^{SLOT_TYPES}{{8}}(?=.)", ""))
    return register | slot | token.isin("cb", "async_cb") | token.rlike(r"^refs=(?:\d+(?:,\d+)*)$")


def _valid(value: Column) -> Column:
    """A frame pointer needs a number for its offset, and a type with an opening bracket a closing one."""
    v = F.when(value.startswith("P"), F.substring(value, 2, 1 << 20)).otherwise(value)
    return F.when(v.startswith("fp") & ~v.startswith("fp("), v.rlike(FRAME_POINTER)).otherwise(~v.contains("(") | v.contains(")"))


# ---- numbers ----


def unsigned(text: Column) -> Column:
    """Decimal or hexadecimal digits as an unsigned 64-bit number; negative ones wrap."""
    n = _magnitude(F.ltrim(text, F.lit("+-")))
    return F.when(text.startswith("-") & (n > 0), (F.lit("18446744073709551616").cast("decimal(21,0)") - n).cast("decimal(21,0)").try_cast(U64)).otherwise(n)


def _magnitude(d: Column) -> Column:
    """Digits without a sign, up to 64 bits; null for what is none."""
    hexadecimal = F.when((F.length(d) <= 18) & d.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(d, 3, 16), 16, 10).try_cast(U64))
    long = d.try_cast(U64)  # of twenty digits not all have 64 bits
    decimal = F.when(d.rlike(r"^\d{1,19}$"), long).when(d.rlike(r"^\d{20}$") & (long <= F.lit("18446744073709551615").cast(U64)), long)
    return F.when(d.startswith("0x") | d.startswith("0X"), hexadecimal).otherwise(decimal)


def natural(text: Column) -> Column:
    """An unsigned 64-bit number that may have a plus; null if negative or malformed."""
    return F.when(~text.startswith("-"), _magnitude(F.ltrim(text, F.lit("+"))))


def signed(t: Column) -> Column:
    """As a signed 64-bit number; hexadecimal digits wrap unless they have a minus."""
    hexadecimal = F.when(t.startswith("-"), (-_magnitude(F.ltrim(t, F.lit("-"))).cast("decimal(21,0)")).try_cast("long")).otherwise(F.when(F.length(t) <= 19, F.conv(F.regexp_extract(t, "^[+]?0[xX]([0-9a-fA-F]{1,16})$", 1), 16, -10).try_cast("long")))
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("long")).when(t.rlike("^[+-]?0[xX]"), hexadecimal)


def _bound32(number: Column, least: int, most: int) -> Column:
    return F.when(number.between(least, most), number)


# ---- attributes ----


def attributes(text: Column) -> Column:
    """(names, values) of `a=1,b=c=2,d=(0x0; 0xff)`, last first; several names may share a value, `_value` behind one is dropped."""
    return let(F.regexp_replace(text, r"\bmem_size=", "sz="), _attributes)


def _attributes(text: Column) -> Column:
    found = lambda k: F.reverse(F.regexp_extract_all(text, F.lit(ATTRIBUTE), F.lit(k)))
    flat = named({"names": found(1), "values": found(2)})
    return F.when(text.rlike(FLAT), flat).otherwise(_nested_attributes(text))


def _nested_attributes(text: Column) -> Column:
    """As `attributes`, of texts whose brackets nest or do not balance."""
    parts = F.transform(top_level_segments(text, ","), lambda x: F.filter(F.transform(F.split(x, "="), lambda y: F.trim(y)), lambda y: y != ""))
    pairs = F.transform(F.filter(parts, lambda p: F.size(p) > 1), lambda p: F.transform(F.slice(p, 1, F.size(p) - 1), lambda n: named({"name": F.regexp_replace(n, "_value$", ""), "value": F.element_at(p, -1)})))
    return let(F.reverse(F.flatten(pairs)), lambda x: named({"names": F.transform(x, lambda y: y["name"]), "values": F.transform(x, lambda y: y["value"])}))


def attribute(pairs: Column, name: str) -> Column:
    """The last value of a name, valid or not: an invalid one overwrites an earlier one."""
    return F.trim(F.get(pairs["values"], F.array_position(pairs["names"], name).cast("int") - 1))


def register_state(value: Column, narrow: Column) -> Column:
    """The state of a register or slot behind `=`: type, precision, exact value, known bits, bounds, offset and ids."""
    return through(start(value, narrow), *STAGES, lambda x: named(state_fields(x)))


def start(value: Column, narrow: Column) -> dict:
    return {"precise": value.startswith("P"), "v": F.when(value.startswith("P"), F.substring(value, 2, 1 << 20)).otherwise(value), "narrow": narrow}


_BOUND_NAMES = ("smin", "smax", "umin", "umax", "smin32", "smax32", "umin32", "umax32")
_SIZES = {"r": "packet_range", "vs": "map_value_size", "sz": "mem_size", "id": "id", "ref_id": "ref_id"}


def _texts(x) -> dict:
    v = x["v"]
    return {"number": _found(v, NUMBER, 1), "is_fp": v.rlike(r"^fp(?!\()"), "inner": F.when(v.contains("("), F.regexp_replace(F.regexp_extract(v, TYPED, 2), r"\bmem_size=", "sz="))}


def _pairs(x) -> dict:
    """Names and values of attributes; of an untyped register none."""
    return {"pairs": F.when(x["inner"].isNotNull(), _attributes(x["inner"]))}


def _named(x) -> dict:
    v = x["v"]
    kind = F.when(x["number"].isNotNull() | (v == "inv") | v.startswith("inv("), "scalar").when(x["is_fp"], "fp").when(x["inner"].isNotNull(), F.substring_index(v, "(", 1)).otherwise(v)
    found = {f"t_{n}": attribute(x["pairs"], n) for n in (*_BOUND_NAMES, *_SIZES, "var_off")}
    off = F.when(x["is_fp"], _found(v, FRAME_POINTER, 2)).otherwise(attribute(x["pairs"], "off"))
    return {"kind": kind, "given": F.when(x["number"].isNotNull(), unsigned(x["number"])), "t_off": off, "source_frame": F.when(x["is_fp"], _found(v, FRAME_POINTER, 1).try_cast("int")), **found}


def _numbers(x) -> dict:
    u32 = lambda c: _bound32(natural(c).try_cast("long"), 0, (1 << 32) - 1)
    i32 = lambda c: _bound32(signed(c), -(1 << 31), (1 << 31) - 1).cast("int")
    parsers = {"smin": signed, "smax": signed, "umin": natural, "umax": natural, "smin32": i32, "smax32": i32, "umin32": u32, "umax32": u32}
    of = lambda name, f: F.when(x[f"t_{name}"].isNotNull(), f(x[f"t_{name}"]))
    bits = of("var_off", lambda c: natural(F.trim(_found(c, r"^\(([^;]+);", 1))))
    mask = of("var_off", lambda c: natural(F.trim(_found(c, r";([^)]+)\)$", 1))))
    given = x["given"].cast("decimal(21,0)")
    half = x["given"] % 4294967296
    return {
        **{f"n_{n}": of(n, f) for n, f in parsers.items()}, **{f"n_{name}": of(n, lambda c: u32(c).try_cast("int")) for n, name in _SIZES.items()},
        "n_off": of("off", i32), "bits": bits, "mask": mask, "half": half.cast("long"), "half_signed": F.when(half > (1 << 31) - 1, half - (1 << 32)).otherwise(half).cast("int"),
        "whole_signed": F.when(x["given"] > (1 << 63) - 1, given - F.lit("18446744073709551616").cast("decimal(21,0)")).otherwise(given).try_cast("long"),
    }


#: What each step finds, from what `start` and the steps before it found.
STAGES = (_texts, _pairs, _named, _numbers)


def state_fields(x) -> dict:
    """An exact value fills the bounds, of a narrow register only the 32-bit ones; bounds that meet make a scalar exact."""
    given, is_scalar = x["given"], x["kind"] == "scalar"
    known = x["bits"].isNotNull() & x["mask"].isNotNull()
    bits, mask = F.when(known, x["bits"]), F.when(known, x["mask"])
    inferred = F.coalesce(F.when(mask == 0, bits), F.when(x["n_umin"] == x["n_umax"], x["n_umin"]))
    by_half = F.when(is_scalar & given.isNull() & inferred.isNull() & (x["n_umin32"] == x["n_umax32"]), x["n_umin32"].cast(U64))
    whole = lambda c, name: F.coalesce(F.when(~x["narrow"], c), x[f"n_{name}"])
    return {
        "reg_type": x["kind"], "narrow": x["narrow"] | by_half.isNotNull(), "precise": F.coalesce(x["precise"], F.lit(False)), "exact": F.when(is_scalar, F.coalesce(given, inferred, by_half)),
        "tnum_value": bits, "tnum_mask": mask, "smin": whole(x["whole_signed"], "smin"), "smax": whole(x["whole_signed"], "smax"), "umin": whole(given, "umin"), "umax": whole(given, "umax"),
        **{name: F.coalesce(x[h], x[f"n_{name}"]) for h, name in (("half_signed", "smin32"), ("half_signed", "smax32"), ("half", "umin32"), ("half", "umax32"))},
        **{name: x[f"n_{name}"] for name in ("packet_range", "map_value_size", "mem_size", "off")}, "source_frame": x["source_frame"], "id": x["n_id"], "ref_id": x["n_ref_id"],
    }


def registers(tokens: Column) -> Column:
    """(reg, state) of each register token, r0 to r10; of one that is named twice, the last. Invalid values are left out."""
    return F.transform(register_texts(tokens), lambda x: named({"reg": x["reg"], "state": register_state(x["value"], x["narrow"])}))


def register_texts(tokens: Column) -> Column:
    """(reg, narrow, value) of each register token: its number, whether only its lower half is written, and the text of its state."""
    found = F.filter(tokens, lambda t: t.startswith("R") & t.rlike(REGISTER))
    name = lambda t: F.substring_index(t, "=", 1)
    parts = F.transform(found, lambda t: named({"reg": F.substring(F.substring_index(name(t), "_", 1), 2, 1 << 20).try_cast("int"), "narrow": name(t).endswith("_w"), "value": F.trim(F.regexp_extract(t, REGISTER, 3))}))
    valid = F.filter(parts, lambda x: _valid(x["value"]))
    return let(valid, lambda p: F.filter(p, lambda x, i: ~F.exists(F.slice(p, i + 2, F.size(p)), lambda y: y["reg"] == x["reg"])))


def text_of(tokens: Column, reg) -> Column:
    """(reg, narrow, value) of one register; null without it."""
    return F.get(F.filter(register_texts(tokens), lambda r: r["reg"] == reg), F.lit(0))


def state_of(tokens: Column, reg) -> Column:
    """The state of one register; null without it. The others are not parsed."""
    return F.get(F.transform(F.filter(register_texts(tokens), lambda r: r["reg"] == reg), lambda x: register_state(x["value"], x["narrow"])), F.lit(0))


def looks_like_state(value: Column) -> Column:
    """Whether a text reads as a register's state: a number, a frame pointer, a type with brackets, or a name that is not all slot types."""
    name = value.rlike("^[A-Za-z0-9_+-]+$") & ~value.rlike(f"^{SLOT_TYPES}+$")
    return (value != "") & (signed(value).isNotNull() | value.startswith("fp") | value.contains("(") | (value == "scalar") | name)


def stack_value(raw: Column) -> Column:
    """(slot_types, value) of what stands behind a slot's `=`; value is a state's text.

    Eight types may stand before a state, or alone. What reads as a state is one, so that `0` is the spilled number and not a type;
    only then can text of another length be types."""
    return let(raw, lambda r: let(named({"raw": r, "rest": F.trim(F.substring(r, 9, 1 << 20))}), _stack_value))


def _stack_value(x: Column) -> Column:
    raw, rest = x["raw"], x["rest"]
    typed, all_types = raw.rlike(f"^{SLOT_TYPES}{{8}}"), raw.rlike(f"^{SLOT_TYPES}+$")
    none = F.lit(None).cast("string")
    pair = lambda t, v: named({"slot_types": t, "value": v})
    return (
        F.when(raw == "", pair(none, none))
        .when(typed & looks_like_state(rest), pair(F.substring(raw, 1, 8), rest))
        .when(typed & (F.length(raw) == 8), pair(raw, none))
        .when(all_types & ~looks_like_state(raw), pair(raw, none))
        .otherwise(pair(none, raw))
    )


def slots(tokens: Column) -> Column:
    """(slot_off, slot_types, value) of each stack token, the last of one that is named twice; value is the state's text, which may be
    the next token."""

    def one(t: Column, i: Column) -> Column:
        after = F.get(tokens, i + 1)
        free = after.isNotNull() & ~after.rlike(REGISTER) & ~after.rlike(SLOT) & looks_like_state(after)
        off = F.regexp_extract(t, SLOT, 1).try_cast("int")
        found = let(stack_value(F.trim(F.regexp_extract(t, SLOT, 2))), lambda x: named({"slot_off": off, "slot_types": x["slot_types"], "value": F.coalesce(x["value"], F.when(free, after))}))
        return F.when(t.rlike(SLOT), found)

    found = F.filter(F.transform(tokens, one), lambda x: x.isNotNull() & x["slot_off"].isNotNull())
    return let(found, lambda p: F.filter(p, lambda x, i: ~F.exists(F.slice(p, i + 2, F.size(p)), lambda y: y["slot_off"] == x["slot_off"])))


def stack_byte(slots: Column, offset: Column) -> Column:
    """The byte of the stack at an offset below the frame's top, if it is known: a zero, or a byte of a spilled number (little-endian).

    slots: a map from offset to (slot_types, state). Types are written from a slot's last byte to its first."""
    home = ((offset - 7) / 8).cast("int") * 8  # towards zero
    index = offset - home
    slot = F.try_element_at(slots, home)
    mark = F.substring(slot["slot_types"], (F.lit(8) - index).cast("int"), F.lit(1))
    exact = F.when(slot["state"]["reg_type"] == "scalar", slot["state"]["exact"])
    byte = F.floor(exact / F.pow(F.lit(256), index).cast(U64)) % 256
    return F.when(offset < 0, F.when(mark == "0", F.lit(0)).when(slot["slot_types"].isNull() | mark.isin("r", ""), byte.cast("int")))


def references(tokens: Column) -> Column:
    """Ids of live references, all of them or none: `refs=2,4`."""
    text = F.try_element_at(F.filter(tokens, lambda t: t.startswith("refs=")), F.lit(-1))
    ids = F.transform(F.split(F.substring(text, 6, 1 << 20), ","), lambda x: x.try_cast("long"))
    return F.when(F.forall(ids, lambda x: F.coalesce(x > 0, F.lit(False))), ids)


def reference_count(tokens: Column) -> Column:
    """`refs=3` as a number, or how many a list has."""
    text = F.substring(F.get(F.filter(tokens, lambda t: t.startswith("refs=")), F.lit(0)), 6, 1 << 20)
    return F.coalesce(text.try_cast("int"), F.when(text.rlike(r"^\d+(?:,\d+)+$"), F.size(F.split(text, ","))))


def callback(tokens: Column) -> Column:
    """sync or async where the state is inside a callback."""
    return F.when(F.array_contains(tokens, "async_cb"), "async").when(F.array_contains(tokens, "cb"), "sync")


def same_loop_state(a: Column, b: Column) -> Column:
    """Whether two states (frame, tokens) are the same but for r10, and say enough: two registers, or one and a slot."""
    plain = lambda s: F.array_sort(F.filter(s["tokens"], lambda t: ~t.startswith("R10=")))
    n = F.size(F.filter(plain(a), lambda t: t.rlike(REGISTER)))
    some_slot = F.exists(a["tokens"], lambda t: t.rlike(SLOT))
    return F.coalesce((a["frame"] == b["frame"]) & (plain(a) == plain(b)) & ((n >= 2) | ((n >= 1) & some_slot)), F.lit(False))

"""Column functions over the text of instructions, `PC: (xx) body`. A tail is the text from the opcode on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INSTRUCTION = r"^\s*(\d+):\s*(?:[0-9.]+\s+)?(\([0-9a-fA-F]{2}\).*)$"
REGISTER = r"(\d{1,3})"


def _found(c: Column, pattern: str, group: int) -> Column:
    """A group of the first match; null without match or with an empty group."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _number(c: Column, pattern: str, group: int = 1) -> Column:
    return _found(c, pattern, group).try_cast("int")


def pc_prefix(line: Column) -> Column:
    return _number(line, r"^\s*(\d+):")


def is_instruction(line: Column) -> Column:
    return line.rlike(INSTRUCTION)


def pc(line: Column) -> Column:
    return _number(line, INSTRUCTION)


def tail(line: Column) -> Column:
    """The instruction from its opcode on; null for other lines."""
    return _found(line, INSTRUCTION, 2)


def opcode(tail_: Column) -> Column:
    return _found(tail_, r"^\(([0-9a-fA-F]{2})\)", 1)


def opcode_body(tail_: Column) -> Column:
    """The text up to a semicolon, opcode included."""
    return F.trim(F.substring_index(tail_, ";", 1))


def body(tail_: Column) -> Column:
    """What follows the opcode, up to a semicolon."""
    return F.trim(F.regexp_replace(F.substring_index(tail_, ";", 1), r"^\([0-9a-fA-F]{2}\)\s*", ""))


# ---- calls ----


def call_target(tail_: Column) -> Column:
    """The word behind the first word `call`, up to `#`. Few instructions are calls, and a plain search tells the others."""
    return F.when(tail_.contains("call"), _found(tail_, r"(?:^|\s)call\s+([^\s#]+)", 1))


def direct_call_target(tail_: Column) -> Column:
    """The target of an instruction that is exactly a direct call."""
    return _found(tail_, r"^\s*\(85\)\s+call\s+([^\s#]+)", 1)


def is_exit(tail_: Column) -> Column:
    return tail_.rlike(r"^\s*\(95\)\s+exit(?:\s|$)")


# ---- registers ----


def register_token(token: Column) -> Column:
    """The number of `rN`, whatever commas and semicolons follow."""
    return _number(token, r"^r(\d+)[,;]*$")


def write_token(token: Column) -> Column:
    """As `register_token`, of `rN` or its lower half `wN`."""
    return _number(token, r"^[rw](\d+)[,;]*$")


def mentioned(text: Column) -> Column:
    """All `rN` in a text, in order, wherever they stand."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"r(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))


def destination(tail_: Column) -> Column:
    """The register that an assignment writes."""
    return _number(tail_, r"^[^)]*\)\s*[rw](\d+)[,;]* = ")


def assigns(tail_: Column, register: Column) -> Column:
    """Whether the text names the register first; a call assigns r0."""
    first = _number(F.substring_index(tail_, ";", 1), r"^[^)]*\)\s*[rw](\d+) ")
    return F.coalesce(first == register, F.lit(False)) | ((register == 0) & call_target(tail_).isNotNull())


def writes(tail_: Column, register: Column) -> Column:
    """Whether an assignment or update writes the register; a call writes r0 to r5."""
    called = tail_.rlike(r"^\s*(?:\(\S*\s+)?call(?:\s|$)")
    written = _number(tail_, r"^\s*(?:\(\S*\s+)?[rw](\d+)[,;]*\s+\S*=(?:\s|$)")
    return F.when(called, register <= 5).otherwise(F.coalesce(written == register, F.lit(False)))


def _assigned(tail_: Column) -> Column:
    """The right side of an assignment."""
    return _found(F.substring_index(tail_, ";", 1), r"^[^)]*\)\s*\S.*? = (.*)$", 1)


def copy_source(tail_: Column) -> Column:
    """The register that is copied whole into the destination."""
    return F.when(destination(tail_).isNotNull(), register_token(F.trim(_assigned(tail_))))


def single_source(tail_: Column) -> Column:
    """The only register of a right side that starts with one."""
    right = _assigned(tail_)
    return F.when(destination(tail_).isNotNull() & right.rlike("^[rw]") & (F.size(mentioned(right)) == 1), F.get(mentioned(right), F.lit(0)))


def added_register(tail_: Column) -> Column:
    return _number(tail_, r"(?:^|\s)r\d+[,;]* \+= r(\d+)[,;]*(?:\s|$)")


def adds(tail_: Column, into: Column, register: Column) -> Column:
    """Whether the text adds one register to another."""
    return F.coalesce((_number(tail_, r"(?:^|\s)r(\d+)[,;]* \+= r\d+[,;]*(?:\s|$)") == into) & (added_register(tail_) == register), F.lit(False))


def uses(tail_: Column, register: Column) -> Column:
    """Whether `rN` is one of the text's words."""
    return F.array_contains(F.split(tail_, "[^A-Za-z0-9]+"), F.concat(F.lit("r"), register.cast("string")))


def reads(tail_: Column, register: Column) -> Column:
    """Whether a register is mentioned in a memory operand, or in a text that assigns nothing."""
    operand = access_operand(tail_)
    return F.when(operand.isNotNull(), F.array_contains(mentioned(operand), register)).when(tail_.contains(" = "), False).otherwise(F.array_contains(mentioned(tail_), register))


def branch_registers(tail_: Column) -> Column:
    """Registers of a conditional branch; null for other instructions."""
    return F.when(tail_.rlike(r"(?:^|\s)if "), mentioned(F.substring_index(_found(tail_, r"(?:^|\s)if (.*)$", 1), " goto ", 1)))


def branch_target(tail_: Column, at: Column) -> Column:
    """Where a jump goes, given its own pc."""
    return F.try_add(at + 1, _number(tail_, r"goto pc([+-]\d+)"))


# ---- memory ----


def access_operand(tail_: Column) -> Column:
    """What stands in brackets behind the type of a memory access."""
    return F.trim(_found(tail_, r"\*\)\(([^)]*)\)", 1))


def access_width(tail_: Column) -> Column:
    """Bytes of a memory access."""
    return F.floor(_number(tail_, r"^(?:(?!\*\(u).)*\*\(u(\d+) \*\)") / 8).cast("int")


def is_load(tail_: Column) -> Column:
    return tail_.contains("= *(")


def is_store(tail_: Column) -> Column:
    return ~is_load(tail_) & tail_.contains("*)(") & tail_.contains(" = ")


def is_atomic(tail_: Column) -> Column:
    text = opcode_body(tail_)
    return (text.contains("atomic") & text.contains("*)(")) | text.contains("lock *(")


def atomic_width(tail_: Column) -> Column:
    """Bytes of an atomic memory access."""
    return F.when(is_atomic(tail_), F.floor(_number(opcode_body(tail_), r"\(u(\d+) \*\)\(") / 8).cast("int"))


def base_register(tail_: Column) -> Column:
    return F.get(mentioned(access_operand(tail_)), F.lit(0))


def access_offset(tail_: Column) -> Column:
    """The signed offset of a memory access; 0 for a bare register."""
    operand = access_operand(tail_)
    plus, minus = _found(operand, r"\+\s*([+-]?\d+)\s*$", 1).try_cast("long"), _found(operand, r"-\s*(\d+)\s*$", 1).try_cast("long")
    return F.when(operand.contains("+"), plus).when(operand.contains("-"), -minus).when(F.size(mentioned(operand)) > 0, F.lit(0).cast("long"))


# ---- validation windows ----


def opens_validation(line: Column) -> Column:
    return line.rlike(r"^Validating .+?\(\) func#")


def closes_validation(line: Column) -> Column:
    return line.startswith("Func#") & line.contains(" is safe for any args")

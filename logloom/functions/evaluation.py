"""Column functions that judge diagnostics against labels: a baseline by words, actions, and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .lines import ascii_lower

# The baseline's cases in order, any of the words decides: error id, class, words.
DICTIONARY = (
    ("E018", "verifier_limit", ("bpf program is too large", "combined stack size", "too many states", "complexity", "loop is not bounded", "processed 1000001 insn")),
    ("E009", "environment_or_configuration", ("program of this type cannot use helper", "cannot use helper", "helper call is not allowed", "calling kernel function", "jit does not support", "missing btf", "invalid bpf_context access", "unknown opcode", "expected=map_ptr", "unknown func", "permission denied")),
    ("E012", "source_bug", ("dynptr",)),
    ("E004", "source_bug", ("unreleased reference", "reference has not")),
    ("E003", "source_bug", ("invalid read from stack", "uninitialized", "r0 !read_ok")),
    ("E002", "source_bug", ("map_value_or_null", "ptr_or_null", "possibly null")),
    ("E001", "source_bug", ("invalid access to packet", "outside of the packet")),
    ("E005", "source_bug", ("unbounded", "min value is negative", "out of bounds", "invalid access to map value", "invalid zero-sized", "makes pkt pointer", "outside of allowed memory range", "invalid variable-offset")),
    ("E006", "source_bug", ("expected pointer", "invalid mem access 'scalar'")),
)
UNKNOWN = ("UNKNOWN", "source_bug")
# The action that a message's words ask for, in order; classes come before words.
CLASS_ACTIONS = (("environment_or_configuration", "environment"), ("verifier_limit", "budget"))
WORD_ACTIONS = (
    ("null", ("null",)), ("release", ("reference",)), ("initialize", ("stack", "uninitialized", "read_ok")), ("bounds", ("bounds", "packet", "map value", "range", "out of bounds")), ("provenance", ("scalar", "pointer")),
)
# The action that a diagnostic's prose asks for, in order, and the class that asks for it as well.
PROSE_ACTIONS = (
    ("environment", "environment_or_configuration", ("kernel version", "program type", "attach type", "btf availability", "capabilities", "supported helper", "kernel capabilities")),
    ("budget", "verifier_limit", ("loop bound", "split complex", "state growth", "stack usage", "budget")),
    ("null", None, ("null",)), ("release", None, ("release",)), ("initialize", None, ("initialize", "initialized")),
    ("bounds", None, ("clamp", "bounds", "bound the scalar", "upper and lower", "data_end", "access range", "map value", "packet", "scalar range", "same ssa value")),
    ("provenance", None, ("branch-specific", "rederive", "pointer provenance", "integer casts", "turn the pointer into a scalar", "verifier-recognized pointer")),
)
# The action of a label, in order: any of the tags' parts, of the fix types, of the fix types' parts, or the class.
LABEL_ACTIONS = (
    ("context", ("sleepability", "context_access"), ("use_correct_context", "avoid_wide_context_access"), (), ()),
    ("bounds", ("stack_bounds", "large_stack_object"), ("add_l2_header_presence_guard", "map_definition_fix", "move_to_map_storage"), (), ()),
    ("protocol", (), (), (), ("reordered",)),
    ("protocol", (), ("move_to_map_value", "use_correct_map_pointer", "use_map_value", "use_stack_copy", "use_valid_pointer"), (), ()),
    ("protocol", ("irq_state", "critical_section"), (), (), ()),
    ("environment", ("helper_availability", "program_type", "btf"), ("env_fix", "change_prog_type", "build_metadata", "loader_fix", "helper_switch", "use_helper_or_correct_context"), (), ("environment_or_configuration",)),
    ("budget", ("verifier_budget",), ("loop_rewrite", "reduce_stack"), (), ("verifier_limit",)),
    ("null", ("nullable",), ("null_check",), (), ()),
    ("release", ("reference",), ("refcount",), (), ()),
    ("initialize", ("stack_read",), ("initialization", "initialize_output_register", "initialize_return", "initialize_pointer"), (), ()),
    ("bounds", (), (), ("bounds", "clamp", "range", "arithmetic"), ()),
    ("provenance", (), (), ("align", "wide", "compiler", "materialization", "truncation", "merge", "signature", "inline", "reorder", "cast", "pointer", "context", "map_value", "map_pointer", "stack_copy", "use_valid_pointer", "use_correct_pointer", "use_map_value", "preserve"), ()),
)
NOT_REORDERED = ("verifier_range_precision", "packet_bounds", "scalar_range")
SOURCE_ACTIONS = ("bounds", "provenance", "null", "initialize", "release", "protocol", "context", "other")
FALLBACK_IDS = ("E099", "UNKNOWN")


def _any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words), F.lit(False))


def _cases(rows, otherwise: Column) -> Column:
    """CASE over (condition, value) in order."""
    out = otherwise
    for condition, value in reversed(list(rows)):
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out


def dictionary(message: Column) -> Column:
    """(error_id, failure_class) by the words of a message: a baseline."""
    return let(ascii_lower(message), lambda low: F.struct(_cases([(_any(low, w), i) for i, _, w in DICTIONARY], F.lit(UNKNOWN[0])).alias("error_id"), _cases([(_any(low, w), c) for _, c, w in DICTIONARY], F.lit(UNKNOWN[1])).alias("failure_class")))


def word_action(message: Column, failure_class: Column) -> Column:
    """The baseline's next action."""
    return let(ascii_lower(message), lambda low: _cases([(failure_class == c, a) for c, a in CLASS_ACTIONS] + [(_any(low, w), a) for a, w in WORD_ACTIONS], F.lit("unspecified")))


def prose_action(help_: Column, required: Column, message: Column, failure_class: Column) -> Column:
    """The action that a diagnostic's own words ask for."""
    text = ascii_lower(F.concat(F.array_join(F.coalesce(help_, F.array().cast("array<string>")), " "), F.lit(" "), F.coalesce(required, F.lit("")), F.lit(" "), F.coalesce(message, F.lit(""))))
    return let(text, lambda low: _cases([((failure_class == c) | _any(low, w) if c else _any(low, w), a) for a, c, w in PROSE_ACTIONS], F.lit("other")))


def diagnostic_action(next_action: Column, help_: Column, required: Column, message: Column, failure_class: Column) -> Column:
    """The action that a diagnostic names, else that of its prose."""
    return F.coalesce(F.nullif(next_action, F.lit("")), prose_action(help_, required, message, failure_class))


def label_action(taxonomy: Column, fix_type: Column, tags: Column) -> Column:
    """The action that a label asks for."""
    fix = ascii_lower(F.coalesce(fix_type, F.lit("")))
    joined = ascii_lower(F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " "))

    def cases(x: Column) -> Column:
        reordered = (taxonomy == "source_bug") & (x["fix"] == "reorder") & ~_any(x["tags"], NOT_REORDERED)
        rows = []
        for action, tag_parts, fixes, fix_parts, classes in LABEL_ACTIONS:
            class_ = reordered if classes == ("reordered",) else taxonomy.isin(*classes) if classes else F.lit(False)
            rows.append((F.coalesce(_any(x["tags"], tag_parts) | (x["fix"].isin(*fixes) if fixes else F.lit(False)) | _any(x["fix"], fix_parts) | class_, F.lit(False)), action))
        return _cases(rows, F.lit("unspecified"))

    return let(F.struct(fix.alias("fix"), joined.alias("tags")), cases)


# ---- scores ----


def proof_score(label_id: Column, label_class: Column, label_action_: Column, error_id: Column, failure_class: Column, action: Column) -> Column:
    """exact, partial (class or action agree) or miss."""
    agrees = (failure_class == label_class) | ((label_action_ != "unspecified") & (action == label_action_))
    return F.when(error_id == label_id, "exact").when(error_id == UNKNOWN[0], "miss").when(agrees, "partial").otherwise("miss")


def root_score(root_pc: Column, pcs: Column, near: int = 5) -> Column:
    """exact, near, miss, or na without a labelled place."""
    hit = lambda k: F.exists(pcs, lambda p: F.abs(p - root_pc) <= k)
    return F.when(root_pc.isNull(), "na").when(F.coalesce(F.size(pcs), F.lit(0)) <= 0, "miss").when(hit(0), "exact").when(hit(near), "near").otherwise("miss")


def action_score(label_action_: Column, action: Column) -> Column:
    """correct, partial, unsafe (a change of code where the environment or budget is at fault, or the reverse), or na."""
    outside, inside = ("environment", "budget"), SOURCE_ACTIONS
    unsafe = (label_action_.isin(*outside) & action.isin(*inside)) | (label_action_.isin(*inside) & action.isin(*outside))
    return F.when(label_action_ == "unspecified", "na").when(action == label_action_, "correct").when(unsafe, "unsafe").otherwise("partial")


# ---- rendered diagnostics ----


def parsed(text: Column) -> Column:
    """The fields of a rendered diagnostic; null if it has no error header."""

    def fields(lines: Column) -> Column:
        trimmed = F.transform(lines, lambda x: F.trim(x))
        after = lambda mark: F.try_element_at(F.transform(F.filter(trimmed, lambda x: x.startswith(mark)), lambda x: F.trim(F.substring(x, len(mark) + 1, 1 << 20))), F.lit(-1))
        place = after("--> ")
        pcs = F.filter(F.transform(F.filter(trimmed, lambda x: x.startswith("= note: nearest BPF instruction pc ")), lambda x: F.regexp_extract(x, r"pc (\d+)$", 1).try_cast("int")), lambda x: x.isNotNull())
        located = place.rlike(r":\d+$")
        warning = F.transform(F.filter(trimmed, lambda x: x.startswith("= warning:") & ~x.startswith("= warning: object analysis:")), lambda x: F.trim(F.substring(x, 11, 1 << 20)))
        return F.struct(
            F.regexp_extract(lines[0], r"^error\[([^\]]+)\]", 1).alias("error_id"), F.regexp_extract(lines[0], r"^error\[[^\]]+\]:\s*(.*)$", 1).alias("message"), F.coalesce(after("= class:"), F.lit("source_bug")).alias("failure_class"),
            after("= next action:").alias("next_action"), F.coalesce(after("= required proof:"), F.lit("")).alias("required"), F.when(located, F.regexp_extract(place, r"^(.*):\d+$", 1)).alias("path"), F.when(located, F.regexp_extract(place, r":(\d+)$", 1).try_cast("int")).alias("line"),
            pcs.alias("pcs"), F.transform(F.filter(trimmed, lambda x: x.startswith("help:")), lambda x: F.trim(F.substring(x, 6, 1 << 20))).alias("help"), F.size(F.filter(trimmed, lambda x: x.startswith("| -"))).alias("related"),
            F.try_element_at(warning, F.lit(-1)).alias("analysis_error"), after("= warning: object analysis:").alias("object_error"),
        )

    return F.when(text.rlike(r"^error\[[^\]]+\]:"), let(F.split(text, "\r?\n"), fields))

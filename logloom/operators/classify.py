"""First-match classification of messages by ordered rules that are rows of small dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.lines import any_of, ascii_lower

# Fixed values: (kind, mode, needles) in the order in which they are tried.
RULES = (
    ("PacketBounds", "any", ("invalid access to packet", "outside of the packet")),
    ("NullablePointer", "any", ("map_value_or_null", "ptr_or_null", "mem_or_null", "possibly null")),
    ("DynptrSafety", "all", ("dynptr", "uninitialized")),
    ("StackInitialized", "any", ("invalid read from stack", "invalid indirect read from stack", "invalid write to stack", "uninitialized", "!read_ok")),
    ("ReferenceLifecycle", "any", ("unreleased reference", "reference has not been released")),
    ("Alignment", "any", ("misaligned", "not aligned")),
    ("HelperArgument", "any", ("caller passes invalid args", "invalid args", "invalid argument", "bad argument", "arg#", "helper access to the packet is not allowed", "cannot call exception cb directly", "only read from")),
    ("StructAccess", "any", ("access beyond struct",)),
    ("ContextUnavailable", "any", ("invalid bpf_context access", "invalid ctx access", "invalid access to context")),
    ("TypeContract", "any", ("unsupported reg type",)),
    ("TypeContract", "all", ("type=", "expected=")),
    ("TypeContract", "any", ("expected pointer", "expected=fp", "expected=pkt", "expected=map_ptr", "expected=map_value")),
    ("InstructionSupport", "any", ("jit does not support", "unsupported", "unknown opcode")),
    ("EnvironmentCapability", "any", ("calling kernel function",)),
    ("DynptrSafety", "any", ("dynptr",)),
    ("KfuncReference", "any", ("kfunc", "trusted", "ref_obj_id", "acquire", "has no valid kptr")),
    ("IteratorLifecycle", "any", ("iter", "iterator")),
    ("LockState", "any", ("irq", "rcu", "lock")),
    ("MapValueBounds", "any", ("invalid access to map value",)),
    ("ScalarRange", "any", ("unbounded", "min value is negative", "min value is outside", "out of bounds", "should have been in", "invalid zero-sized", "makes pkt pointer", "outside of allowed memory range", "outside of the allowed memory range", "invalid variable-offset", "invalid access to memory")),
    ("PointerProvenance", "any", ("invalid mem access 'scalar'", "invalid mem access 'inv'", "same insn cannot be used with different pointers", "pointer arithmetic", "bitwise operator", "dereference of modified ctx ptr")),
    ("LoopBound", "any", ("loop is not bounded", "infinite loop detected", "back-edge")),
    ("VerifierLimit", "any", ("too many states", "bpf program is too large", "combined stack size", "complexity", "combined stack", "processed 1000001 insn")),
    ("EnvironmentCapability", "any", ("unknown func", "helper call is not allowed", "program of this type cannot use helper", "cannot use helper", "cannot pass map_type", "kernel subsystem misconfigured verifier", "missing btf", "cannot call", "permission denied")),
)

# Kind, error id, obligation, failure class.
KINDS = (
    ("PacketBounds", "E001", "PacketBounds", "source_bug"),
    ("NullablePointer", "E002", "NullablePointer", "source_bug"),
    ("StackInitialized", "E003", "StackInitialized", "source_bug"),
    ("ReferenceLifecycle", "E004", "ReferenceLifecycle", "source_bug"),
    ("MapValueBounds", "E005", "ScalarRange", "source_bug"),
    ("ScalarRange", "E005", "ScalarRange", "source_bug"),
    ("PointerProvenance", "E006", "PointerProvenance", "source_bug"),
    ("Alignment", "E007", "Alignment", "source_bug"),
    ("TypeContract", "E008", "TypeContract", "source_bug"),
    ("EnvironmentCapability", "E009", "EnvironmentCapability", "environment_or_configuration"),
    ("HelperArgument", "E010", "HelperArgument", "source_bug"),
    ("StructAccess", "E011", "ContextAccess", "source_bug"),
    ("ContextUnavailable", "E011", "ContextAccess", "environment_or_configuration"),
    ("DynptrSafety", "E012", "DynptrSafety", "source_bug"),
    ("KfuncReference", "E013", "KfuncReference", "source_bug"),
    ("IteratorLifecycle", "E014", "IteratorLifecycle", "source_bug"),
    ("LockState", "E015", "LockState", "source_bug"),
    ("InstructionSupport", "E016", "InstructionSupport", "environment_or_configuration"),
    ("LoopBound", "E018", "LoopBound", "source_bug"),
    ("VerifierLimit", "E018", "VerifierLimit", "verifier_limit"),
    ("Unsupported", "E099", "Unknown", "unsupported_verifier_message"),
)
# What shows that a call on a dynptr failed, whatever else the message says.
DYNPTR_CONTEXT = ("unacquired reference", "reference type", "expected an initialized", "expected pointer to stack", "does not allow writes to packet data")


def kinds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KINDS), "kind string, error_id string, obligation string, failure_class string")


def _fits(low: Column, mode: str, needles) -> Column:
    return any_of(low.contains(n) for n in needles) if mode == "any" else ~any_of(~low.contains(n) for n in needles)


def first_rule(message: Column) -> Column:
    """The number (from 1) of the first rule that fits; null if none does. One CASE in the rules' order."""

    def cases(low: Column) -> Column:
        out = F.lit(None).cast("int")
        for k, (_, mode, needles) in reversed(list(enumerate(RULES, 1))):
            out = F.when(_fits(low, mode, needles), F.lit(k)).otherwise(out)
        return out

    return let(ascii_lower(message), cases)


def kind_of(rule: Column) -> Column:
    """The kind that a rule's number stands for."""
    out = F.lit("Unsupported")
    for k, (kind, _, _) in reversed(list(enumerate(RULES, 1))):
        out = F.when(rule == k, F.lit(kind)).otherwise(out)
    return out


def classified(messages: DataFrame, message: str = "message", call_target: str | None = None) -> DataFrame:
    """Adds rule, kind, error_id, obligation and failure_class."""
    kind = kind_of(F.col("rule"))
    if call_target:
        low = ascii_lower(F.col(message))
        kind = F.when(F.coalesce(F.col(call_target).contains("dynptr"), F.lit(False)) & any_of(low.contains(m) for m in DYNPTR_CONTEXT), F.lit("DynptrSafety")).otherwise(kind)
    return messages.withColumn("rule", first_rule(F.col(message))).withColumn("kind", kind).join(F.broadcast(kinds(messages.sparkSession)), "kind")  # a table of fixed length

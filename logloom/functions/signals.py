"""Proof signals: why a proof was missing, told from the look-ups at a rejection (`operators.sites.contexts`).

`SIGNALS` is the dimension of all signals in their order; `PREDICATES` says of a context when one holds. Contexts carry prepared
columns: low (the message in lower case), tail, base, off, width, target and direct (of the site), regs, and `operators.signals`' own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import helpers as H
from . import instructions as I
from . import messages as M
from . import ranges as R
from . import sources as T

# Name, failure class, next action, rank (the lowest wins), whether it may replace an unsupported terminal, whether it
# replaces the class's help, error id (null: the class's own).
SIGNALS = (
    ("WideStackAlignment", "lowering_artifact", "Provenance", 20, False, False, None),
    ("AtomicMemoryAccessScalarBase", "source_bug", "Provenance", 10, False, True, "E007"),
    ("LoopBackEdgeStateRepeats", "source_bug", "Budget", 10, False, True, "E018"),
    ("SharedInstructionPointerMerge", "lowering_artifact", "Provenance", 20, False, False, None),
    ("SharedInstructionPathProofLoss", "lowering_artifact", "Provenance", 10, False, False, None),
    ("Alu32PointerCopyDropsProvenance", "lowering_artifact", "Provenance", 10, False, False, None),
    ("ConstantScalarMemoryLoad", "lowering_artifact", "Provenance", 10, False, False, None),
    ("SharedInstructionUninitializedRegister", "lowering_artifact", "Initialize", 10, False, False, None),
    ("PointerShiftDropsProvenance", "lowering_artifact", "Provenance", 20, False, False, None),
    ("ModifiedContextPointer", "lowering_artifact", "Context", 20, False, False, None),
    ("SubprogramContextArgumentDropped", "lowering_artifact", "Provenance", 20, False, False, None),
    ("PacketPointerProofLostAfterBoundsCheck", "lowering_artifact", "Provenance", 10, False, False, None),
    ("PacketRangeProofLostBeforeAccess", "lowering_artifact", "Bounds", 10, False, False, None),
    ("PacketAccessWithoutBoundsProof", "source_bug", "Bounds", 50, False, True, "E001"),
    ("MapValueWideAccess", "lowering_artifact", "Bounds", 10, False, False, None),
    ("MapValueCheckedOffsetRelationLost", "lowering_artifact", "Provenance", 10, False, False, None),
    ("MapValueGuardExceedsValueSize", "source_bug", "Bounds", 5, True, False, None),
    ("MapValueAccessOutOfBounds", "source_bug", "Bounds", 6, False, True, "E005"),
    ("MemoryObjectAccessOutOfBounds", "source_bug", "Bounds", 55, False, True, "E005"),
    ("ReturnRangeOutOfBounds", "source_bug", "Bounds", 55, False, True, "E005"),
    ("StackVariableOffsetOutOfBounds", "source_bug", "Bounds", 55, False, True, "E005"),
    ("ScalarRangeUnsafeAtUse", "source_bug", "Bounds", 60, False, True, None),
    ("MapPointerArgumentScalarZero", "environment_or_configuration", "Environment", 10, True, True, "E021"),
    ("BtfFuncInfoMissing", "environment_or_configuration", "Environment", 10, True, True, "E021"),
    ("SubprogramReferenceMetadataMissing", "source_bug", "Provenance", 10, True, True, "E021"),
    ("DynptrStackStorageAccess", "source_bug", "Protocol", 10, True, True, "E012"),
    ("DynptrUninitializedArgument", "source_bug", "Protocol", 10, False, True, "E012"),
    ("DynptrReferencedSlotOverwrite", "source_bug", "Protocol", 10, False, True, "E012"),
    ("DynptrReadonlyPacketWrite", "source_bug", "Environment", 10, False, True, "E012"),
    ("DynptrStackSlotWriteOverlap", "source_bug", "Protocol", 10, True, True, "E019"),
    ("DynptrHelperArgumentStateMismatch", "source_bug", "Protocol", 10, True, True, "E019"),
    ("DynptrReleaseUnacquiredReference", "source_bug", "Release", 10, True, True, "E019"),
    ("DynptrSliceVariableLength", "source_bug", "Bounds", 10, True, True, "E019"),
    ("IteratorStackStorageAccess", "source_bug", "Protocol", 10, True, True, "E014"),
    ("IteratorHelperArgumentStateMismatch", "source_bug", "Protocol", 10, True, True, "E014"),
    ("IrqFlagStateMismatch", "source_bug", "Protocol", 10, True, True, "E020"),
    ("IrqRestoreOrderMismatch", "source_bug", "Protocol", 10, True, True, "E013"),
    ("IrqRestoreHelperClassMismatch", "source_bug", "Protocol", 10, True, True, "E013"),
    ("IrqStateLiveAtExit", "source_bug", "Protocol", 10, True, True, "E013"),
    ("SleepableCallInNonSleepableContext", "source_bug", "Context", 7, True, True, "E016"),
    ("CallbackCallWhileLocked", "source_bug", "Protocol", 10, True, True, "E015"),
    ("NullablePointerUseWithoutProof", "source_bug", "Null", 10, False, True, "E002"),
    ("NullScalarDereferenceAfterPointerProof", "source_bug", "Null", 10, False, False, "E011"),
    ("TrustedNullableArgument", "source_bug", "Null", 10, True, True, "E015"),
    ("KfuncArgumentTypeMismatch", "source_bug", "Protocol", 10, False, True, "E013"),
    ("VerifierTypeContractMismatch", "source_bug", "Protocol", 12, False, True, "E008"),
    ("ModernBpfObjectProtocolViolation", "source_bug", "Protocol", 8, False, True, "E023"),
    ("ContextAccessSourceArgumentMismatch", "source_bug", "Context", 10, True, True, None),
    ("TraceContextScalarArgumentMismatch", "source_bug", "Context", 10, True, True, "E011"),
    ("ContextFieldUnavailable", "environment_or_configuration", "Context", 10, False, True, None),
    ("PacketContextFieldAccessInUnsupportedProgram", "source_bug", "Environment", 10, False, True, "E011"),
    ("KernelObjectFieldAccessMismatch", "source_bug", "Context", 10, False, True, "E011"),
    ("ExceptionThrowWithLiveReference", "source_bug", "Release", 10, True, True, "E004"),
    ("ReferenceLiveAtExit", "source_bug", "Release", 10, True, True, "E004"),
    ("ExceptionCallbackProtocolViolation", "source_bug", "Protocol", 10, False, True, "E013"),
    ("MapLookupKeyArgumentUnreadable", "source_bug", "Initialize", 10, True, True, None),
    ("UnreadableProgramEntryArgument", "source_bug", "Context", 10, False, True, "E011"),
    ("UnreadableHelperArgument", "source_bug", "Initialize", 10, False, True, "E010"),
    ("MapPointerRawAccessContract", "source_bug", "Protocol", 10, False, True, "E010"),
    ("PerfEventOutputPacketAccess", "source_bug", "Protocol", 10, False, True, "E010"),
    ("UnreadableReturnRegister", "source_bug", "Initialize", 10, False, True, "E003"),
    ("LegacySkbLoadUnreadableRegister", "source_bug", "Context", 10, False, True, "E003"),
    ("HelperStackReadLengthExceedsInitializedRange", "source_bug", "Bounds", 9, False, True, "E003"),
    ("HelperStackReadExceedsInitializedRange", "source_bug", "Initialize", 10, False, True, "E003"),
    ("HelperStackWriteBeyondFrame", "source_bug", "Bounds", 10, False, True, "E006"),
    ("ScalarValueUsedAsPointer", "source_bug", "Provenance", 10, False, True, "E011"),
    ("OpaqueScalarPointerDereference", "source_bug", "Protocol", 10, False, False, "E011"),
    ("StalePointerAfterInvalidatingHelper", "source_bug", "Provenance", 10, False, True, "E011"),
    ("DynptrDataPointerInvalidatedBeforeUse", "source_bug", "Protocol", 10, False, True, "E011"),
    ("ProhibitedPointerArithmetic", "source_bug", "Provenance", 10, False, True, None),
    ("PacketGuardUndercoversAccess", "source_bug", "Bounds", 40, True, False, None),
    ("PacketMaxOffsetPrecisionBoundary", "verifier_false_positive", "Bounds", 30, True, False, None),
    ("MapValueRelationPrecisionBoundary", "verifier_false_positive", "Bounds", 4, True, False, None),
)
# Base classes that a signal may override besides its own rule (all others: source_bug).
OVERRIDES = {
    "ExceptionThrowWithLiveReference": ("environment_or_configuration",),
    "ContextAccessSourceArgumentMismatch": ("source_bug", "environment_or_configuration"),
    "ContextFieldUnavailable": ("environment_or_configuration",),
    "BtfFuncInfoMissing": ("environment_or_configuration", "unsupported_verifier_message"),
    "SubprogramReferenceMetadataMissing": ("source_bug", "environment_or_configuration", "unsupported_verifier_message"),
}
# The order in which signals are asked where ranks are equal. Those of FALLBACKS are asked only if no other holds,
# and each only if none before it does.
ORDER = (
    "WideStackAlignment", "AtomicMemoryAccessScalarBase", "LoopBackEdgeStateRepeats", "PointerShiftDropsProvenance", "ModifiedContextPointer", "SharedInstructionPointerMerge", "SubprogramContextArgumentDropped",
    "Alu32PointerCopyDropsProvenance", "SharedInstructionPathProofLoss", "ConstantScalarMemoryLoad", "SharedInstructionUninitializedRegister", "MapValueRelationPrecisionBoundary", "PacketMaxOffsetPrecisionBoundary",
    "ContextAccessSourceArgumentMismatch", "TraceContextScalarArgumentMismatch", "ContextFieldUnavailable", "PacketContextFieldAccessInUnsupportedProgram", "KernelObjectFieldAccessMismatch", "ExceptionThrowWithLiveReference", "ReferenceLiveAtExit",
    "ExceptionCallbackProtocolViolation", "MapPointerArgumentScalarZero", "BtfFuncInfoMissing", "SubprogramReferenceMetadataMissing", "MapLookupKeyArgumentUnreadable", "UnreadableProgramEntryArgument", "UnreadableHelperArgument",
    "MapPointerRawAccessContract", "PerfEventOutputPacketAccess", "UnreadableReturnRegister", "LegacySkbLoadUnreadableRegister", "HelperStackReadLengthExceedsInitializedRange", "HelperStackReadExceedsInitializedRange", "HelperStackWriteBeyondFrame",
    "DynptrUninitializedArgument", "DynptrReferencedSlotOverwrite", "DynptrReadonlyPacketWrite", "DynptrStackSlotWriteOverlap", "DynptrStackStorageAccess", "DynptrHelperArgumentStateMismatch", "DynptrReleaseUnacquiredReference", "DynptrSliceVariableLength",
    "IteratorHelperArgumentStateMismatch", "IteratorStackStorageAccess", "IrqFlagStateMismatch", "IrqRestoreOrderMismatch", "IrqRestoreHelperClassMismatch", "IrqStateLiveAtExit", "SleepableCallInNonSleepableContext", "CallbackCallWhileLocked",
    "NullablePointerUseWithoutProof", "ModernBpfObjectProtocolViolation", "KfuncArgumentTypeMismatch", "TrustedNullableArgument", "VerifierTypeContractMismatch", "MemoryObjectAccessOutOfBounds", "ReturnRangeOutOfBounds", "StackVariableOffsetOutOfBounds",
    "ScalarRangeUnsafeAtUse", "PacketPointerProofLostAfterBoundsCheck", "PacketRangeProofLostBeforeAccess", "PacketGuardUndercoversAccess", "PacketAccessWithoutBoundsProof", "MapValueWideAccess", "MapValueCheckedOffsetRelationLost", "MapValueGuardExceedsValueSize",
    "MapValueAccessOutOfBounds",
)
FALLBACKS = ("StalePointerAfterInvalidatingHelper", "DynptrDataPointerInvalidatedBeforeUse", "OpaqueScalarPointerDereference", "NullScalarDereferenceAfterPointerProof", "ScalarValueUsedAsPointer", "ProhibitedPointerArithmetic")


def dimension(spark: SparkSession) -> DataFrame:
    """(signal, failure_class, action, rank, replaces_unsupported, replaces_help, error_id, place): one row for each signal."""
    place = {n: k for k, n in enumerate((*ORDER, *FALLBACKS))}
    rows = [(*row, place[row[0]]) for row in SIGNALS]
    return spark.createDataFrame(rows, "signal string, signal_class string, signal_action string, rank int, replaces_unsupported boolean, replaces_help boolean, signal_error_id string, place int")


def can_override(signal: Column, base_class: Column, replaces_unsupported: Column) -> Column:
    """Whether a signal may take the place of a terminal's class."""
    special = F.lit(False)
    for name, classes in OVERRIDES.items():
        special = F.when(signal == name, base_class.isin(*classes)).otherwise(special)
    usual = F.when(signal.isin(*OVERRIDES), special).otherwise(base_class == "source_bug")
    return F.when(base_class == "unsupported_verifier_message", replaces_unsupported).otherwise(usual)


# ---- parts of predicates ----


def _c(name: str) -> Column:
    return F.col(name)


def _says(*parts: str) -> Column:
    """The message contains all parts, in lower case."""
    return _all(*(_c("low").contains(p) for p in parts))


def _says_any(*parts: str) -> Column:
    return _any(*(_c("low").contains(p) for p in parts))


def _all(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _any(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _reg(n, look_up: str) -> Column:
    """The state of a register by one of its look-ups."""
    return F.try_element_at("regs", F.lit(n) if isinstance(n, int) else n)[look_up]["state"]


def _kind(n, look_up: str = "before") -> Column:
    return _reg(n, look_up)["reg_type"]


def _obligation(*names: str) -> Column:
    return _c("obligation").isin(*names)


def _offset(state: Column) -> Column:
    return F.coalesce(state["off"], F.lit(0)).cast("long")


_SCALAR_ACCESS = ("invalid mem access 'scalar'", "invalid mem access 'inv'")
_BASE, _REG = lambda: _c("base"), lambda: _c("register")


def _misaligned(kind: str) -> Column:
    return F.when(_c("message").contains(kind), F.coalesce(M.natural_after(_c("message"), "size "), M.natural_after(_c("message"), "size=")))


# ---- predicates over the context alone ----


def wide_stack_alignment():
    size, base = _misaligned("misaligned stack access"), _reg(_BASE(), "before")
    return _obligation("Alignment") & (size > 0) & (_c("width") == size) & (base["reg_type"] == "fp") & (F.pmod(_offset(base) + _c("off"), size) != 0)


def atomic_scalar_base():
    size = _misaligned("misaligned access")
    kind = F.coalesce(_kind(_BASE(), "before_all"), _kind(_BASE()))
    return _obligation("Alignment") & (size > 0) & I.is_atomic(_c("tail")) & (I.atomic_width(_c("tail")) == size) & (kind == "scalar")


def loop_repeats():
    return _obligation("LoopBound") & _c("loop_repeats")


def pointer_shift():
    shifted = _c("tail").contains(F.concat(F.lit("r"), _REG().cast("string"), F.lit(" <<=")))
    return _obligation("PointerProvenance") & _c("message").contains("pointer arithmetic with <<=") & shifted & R.pointer_like(_reg(_REG(), "before"))


def modified_context():
    s = _reg(_REG(), "before")
    return _c("message").contains("dereference of modified ctx ptr") & (_BASE() == _REG()) & (s["reg_type"] == "ctx") & (_offset(s) != 0) & (_offset(s) == M.natural_after(_c("message"), "off="))


def pointer_merge():
    here, kind = F.try_element_at("regs", _BASE())["types_here"], _kind(_BASE())
    return _c("message").contains("same insn cannot be used with different pointers") & R.pointer_like(_reg(_BASE(), "before")) & F.exists(here, lambda t: t != kind)


def dropped_context_argument():
    r1 = F.try_element_at("regs", F.lit(1))
    return _says("expects pointer to ctx", "caller passes invalid args into func") & _c("tail").contains("call pc+") & (_c("first_argument") == "ctx") & (_kind(1) != "ctx") & (r1["was_ctx"] == 1)


def _bytecode_only(name: str, condition):
    """Of logs without quoted sources."""
    return _c("n_sources").isNull() & _obligation(name) & condition


def alu32_copy():
    return _bytecode_only("PointerProvenance", _c("alu32_copy"))


def path_proof_loss():
    return _bytecode_only("PointerProvenance", (F.try_element_at("regs", _REG())["pointer_at_error"] == 1) & ~F.coalesce(_c("alu32_copy"), F.lit(False)))


def constant_load():
    r = F.try_element_at("regs", _REG())
    return _bytecode_only("PointerProvenance", ~F.coalesce(_c("alu32_copy"), F.lit(False)) & (F.coalesce(r["pointer_at_error"], F.lit(0)) == 0) & _c("message").contains("invalid mem access 'scalar'") & r["last"]["state"]["exact"].between(1, 4096))


def uninitialized_shared():
    return _bytecode_only("StackInitialized", _c("message").contains("!read_ok") & (F.try_element_at("regs", _REG())["seen_at_error"] == 1))


def map_wide_access():
    a, s = _c("access"), _reg(_REG(), "last")
    return M.wider_than_value(a) & (_c("width") == a["size"]) & (s["reg_type"] == "map_value") & (s["map_value_size"] == a["value_size"])


def _map_state(look_up: str, n) -> Column:
    s = _reg(n, look_up)
    return (s["reg_type"] == "map_value") & (s["map_value_size"] == _c("access.value_size"))


def map_offset_lost():
    guard = F.col("scalar_guard.source")
    a, s = _c("access"), _reg(_REG(), "last")
    linked = F.size(F.array_intersect(T.identifiers(guard["text"]), T.identifiers(_c("rejected.text")))) >= 2
    mentions = T.is_scalar_guard(guard["text"]) & F.array_contains(T.numbers(guard["text"]), a["value_size"])
    return _obligation("ScalarRange") & ~M.wider_than_value(a) & M.ends_behind_value(a) & mentions & (linked | F.coalesce(_c("guard_linked"), F.lit(False))) & _map_state("last", _REG()) & R.offset_may_exceed(s)


def map_out_of_bounds():
    a = _c("access")
    pair = H.map_value_access_pair(_c("direct"))
    reg = F.coalesce(_BASE(), pair.first, _REG())
    s, length = _reg(reg, "before_all"), _reg(pair.second, "before_all")
    by_access = ~M.wider_than_value(a) & (_BASE() == reg) & (_c("width") == a["size"]) & (_offset(s) + _c("off") == a["off"])
    by_helper = (pair.first == reg) & (_offset(s) == a["off"]) & _any(*(F.coalesce(length[b] == a["size"], F.lit(False)) for b in ("exact", "umax", "smax", "umax32", "smax32")))
    return M.ends_behind_value(a) & _c("site").isNotNull() & _map_state("before_all", reg) & F.when(_BASE().isNotNull(), by_access).otherwise(by_helper)


def memory_out_of_bounds():
    m, s = _c("message"), _reg(_BASE(), "before_all")
    size_of, off, size = M.natural_after(m, "mem_size="), M.signed_after(m, "off="), M.natural_after(m, "size=")
    kind = (s["mem_size"] == size_of) & ((s["reg_type"] == "mem") | s["reg_type"].endswith("_mem"))
    return _obligation("ScalarRange") & _says("invalid access to memory", "mem_size=") & ((off < 0) | (off + size > size_of)) & (_c("width") == size) & (_REG().isNull() | (_REG() == _BASE())) & kind & (_offset(s) + _c("off") == off)


def return_out_of_range():
    need = M.required_return_range(_c("message"))
    s = _reg(F.coalesce(_REG(), F.lit(0)), "at_all")
    return _obligation("ScalarRange") & _says("at program exit", "register r", "should have been in") & need.isNotNull() & I.is_exit(_c("tail")) & R.outside(s, need["lo"], need["hi"])


def stack_variable_offset():
    s = _reg(_BASE(), "before_all")
    start = lambda c: F.try_add(_offset(s) + _c("off"), c)
    low, high = start(R.lowest(s)), F.try_add(start(R.highest(s)), _c("width").cast("long"))
    leaves = F.coalesce(low < -512, F.lit(True)) | F.coalesce(high > 0, F.lit(True))
    return _obligation("ScalarRange") & _says("unbounded variable-offset", "stack") & _c("width").isNotNull() & (_REG().isNull() | (_REG() == _BASE())) & (s["reg_type"] == "fp") & R.variable_offset(s) & leaves


_NEEDS_BOUND = ("min value is negative", "zero-sized", "unbounded variable-offset", "unbounded memory access", "math between", "invalid access to map value", "invalid access to memory", "pointer be out of bounds", "outside of the allowed memory range")


def scalar_unsafe():
    s, body = _reg(_REG(), "before"), I.opcode_body(_c("tail"))
    consumed = F.when(_c("direct").isNotNull(), H.consumes_scalar_length(_c("direct"), _REG())).otherwise(I.reads(body, _REG()))
    unsafe = (
        F.when(_says("zero-sized"), R.may_include_zero(s)).when(s["exact"].isNotNull(), s["exact"] > R.I32_MAX).when(R.offset_may_exceed(s), True)
        .when((s["reg_type"] != "scalar") & ~R.bounded(s), False).otherwise(R.may_be_negative(s) | R.too_large(s))
    )
    return _obligation("ScalarRange") & ~_says("program exit") & _says_any(*_NEEDS_BOUND) & consumed & s.isNotNull() & unsafe


def map_argument_zero():
    argument, source = T.call_argument(_c("rejected.text"), "bpf_map_lookup_elem", 0), _c("rejected.text")
    proof = ~T.is_literal_null(argument) & (T.lost_relocation(argument) | F.coalesce(_c("declared_maps_hold"), F.lit(False)))
    return _c("message").contains("expected=map_ptr") & (_REG() == 1) & _c("tail").contains("call bpf_map_lookup_elem#") & source.contains("bpf_map_lookup_elem") & proof & R.is_zero(_reg(1, "last"))


def func_info_missing():
    return (_c("low") == "missing btf func_info") & _c("has_subprogram")


def subprogram_reference():
    unknown = _says("reference type('unknown", "size cannot be determined") | F.exists("prior", lambda x: M.has(x, "reference type('unknown", "size cannot be determined"))
    erased = F.lower(F.regexp_replace(_c("call_argument"), r"\s", ""))
    n = M.argument_register_after(_c("message"), "arg#")
    bare = T.is_bare_identifier(_c("call_argument")) & (_kind(n) == "ctx")
    return _says("caller passes invalid args into func") & unknown & _c("tail").contains("call pc+") & _c("call_argument").isNotNull() & (erased.contains("(void*)") | (erased == "void*") | bare)


_DYNPTR = ("DynptrSafety", "HelperArgument", "ReferenceLifecycle", "StackInitialized", "TypeContract", "Unknown")


def _stable(s: Column) -> Column:
    return (s["reg_type"] == "fp") & (s["off"] < 0) & ~R.variable_offset(s)


def _met(access: str, field: str) -> Column:
    return F.coalesce(F.try_element_at("overlaps", F.lit(access))[field] == 1, F.lit(False))


def _argument(role) -> Column:
    return _reg(role(_c("c_target")), "argument")


def dynptr_storage():
    slice_ = F.coalesce(_c("rejected.text").contains("bpf_dynptr_slice"), F.lit(False)) & _c("message").contains("memory, len pair")
    return _obligation("StackInitialized", "Unknown") & ~slice_ & _met("dynptr_read", "target")


def dynptr_write_overlap():
    return _obligation("DynptrSafety", "HelperArgument", "StackInitialized", "Unknown") & _says("potential write to dynptr") & _met("dynptr_write", "target")


def dynptr_uninitialized():
    return _obligation(*_DYNPTR) & _says("expected an initialized dynptr") & _stable(_argument(H.dynptr_initialized)) & ~_met("dynptr_initialized", "exact") & ~_met("dynptr_initialized", "interior")


def dynptr_overwrite():
    return _obligation(*_DYNPTR) & _says("cannot overwrite referenced dynptr") & (_met("dynptr_output", "live") | _met("plain_write", "any_live"))


def dynptr_readonly_write():
    return _obligation(*_DYNPTR) & _says("does not allow writes to packet data") & (_c("c_target") == "bpf_dynptr_slice_rdwr") & (_c("dynptr_backing") == "packet")


def dynptr_argument_mismatch():
    output = _argument(H.dynptr_output)
    from_stack = (_c("c_target") == "bpf_dynptr_from_mem") & (_kind(1, "argument") == "fp")
    return _obligation("DynptrSafety", "HelperArgument", "TypeContract", "ReferenceLifecycle", "Unknown") & ((output.isNotNull() & ~F.coalesce(_stable(output), F.lit(False))) | F.coalesce(from_stack, F.lit(False)) | _met("dynptr_live", "interior"))


def dynptr_unacquired():
    releases = _c("c_target").isin("bpf_ringbuf_discard_dynptr", "bpf_ringbuf_submit_dynptr")
    return _obligation("DynptrSafety", "ReferenceLifecycle", "HelperArgument", "Unknown") & _says("unacquired reference") & releases & _met("dynptr_live", "exact") & _c("state_before").isNotNull() & (F.coalesce(_c("state_before.refs"), F.lit(0)) == 0)


def dynptr_slice_length():
    s = _reg(4, "argument")
    return _c("c_target").isin("bpf_dynptr_slice", "bpf_dynptr_slice_rdwr") & (s["reg_type"] == "scalar") & s["exact"].isNull()


def iterator_storage():
    return _obligation("StackInitialized", "Unknown") & _met("iter_read", "target")


def iterator_argument():
    is_new, is_used = _c("target").endswith("_new"), _c("target").endswith("_next") | _c("target").endswith("_destroy")
    s, seen = _reg(1, "argument"), F.try_element_at("overlaps", F.lit("iter_argument"))
    live = F.size(F.array_intersect(seen["target_refs"], F.coalesce("state_before.ref_ids", F.array().cast("array<long>")))) > 0
    used = F.when(seen["any_target"] == 0, True).when(seen["any_target"] == 1, ~live & _says("expected an initialized iter")).otherwise(False)
    wrong = F.when(s["reg_type"] != "fp", True).when(is_new, F.try_element_at("overlaps", F.lit("iter_new")).isNotNull()).otherwise(used)
    return _obligation("IteratorLifecycle", "HelperArgument", "StackInitialized", "Unknown") & _c("target").startswith("bpf_iter_") & (is_new | is_used) & s.isNotNull() & wrong


def _irq_slot() -> Column:
    """Whether the flag's slot is live (1) or has ordinary bytes (0); null if no state says."""
    seen = F.try_element_at("overlaps", F.lit("irq"))
    return F.when(seen["irq"].isNotNull(), seen["irq"]).when(seen["covered"] == 1, 0)


def irq_flag():
    s = _reg(1, "argument")
    saves, restores = _c("target") == "bpf_local_irq_save", _c("target") == "bpf_local_irq_restore"
    wrong = F.when(s["reg_type"] != "fp", True).when(saves, _irq_slot().isNotNull()).otherwise(_irq_slot() == 0)
    return _obligation("LockState", "HelperArgument", "StackInitialized", "Unknown") & (saves | restores) & s.isNotNull() & wrong


_IRQ = ("LockState", "KfuncReference", "ReferenceLifecycle", "HelperArgument", "Unknown")


def _irq_live() -> Column:
    s = _reg(F.when(_c("c_target") == "bpf_local_irq_restore", 1).when(_c("c_target") == "bpf_res_spin_unlock_irqrestore", 2), "argument")
    return (s["reg_type"] == "fp") & ~R.variable_offset(s) & (_irq_slot() == 1)


def irq_order():
    expected = M.natural_after(_c("low"), "expected id=")
    local = F.array_contains("ref_state.ref_ids", expected)
    locked = (_c("c_target") == "bpf_res_spin_unlock_irqrestore") & (_c("acquired_target") == "bpf_res_spin_lock_irqsave")
    return _obligation(*_IRQ) & _says("cannot restore irq state out of order") & expected.isNotNull() & _c("acquired_target").isin("bpf_local_irq_save", "bpf_res_spin_lock_irqsave") & _irq_live() & F.when(_c("c_target") == "bpf_local_irq_restore", local).otherwise(locked)


def irq_class():
    crossed = ((_c("c_target") == "bpf_local_irq_restore") & (_c("irq_origin") == "bpf_res_spin_lock_irqsave")) | ((_c("c_target") == "bpf_res_spin_unlock_irqrestore") & (_c("irq_origin") == "bpf_local_irq_save"))
    return _obligation(*_IRQ) & _says("function calls are not allowed", "holding a lock") & _irq_live() & crossed


def irq_at_exit():
    return _obligation("LockState", "KfuncReference", "ReferenceLifecycle", "Unknown") & _says("bpf_exit instruction", "bpf_local_irq_save-ed") & _c("tail").contains("exit") & F.arrays_overlap(_c("irq_save_refs"), _c("state_at.ref_ids"))


def sleepable_call():
    return _says_any("may sleep", "sleepable helper", "non-sleepable") & _says_any("non-sleepable", "preempt-disabled") & _c("tail").contains("call ") & (_c("irq_depth") > 0)


def callback_locked():
    invokes = _c("callback_origin").contains("rbtree") | _c("callback_origin").isin("bpf_loop", "bpf_for_each_map_elem", "bpf_user_ringbuf_drain", "bpf_find_vma")
    return _says("function calls are not allowed", "holding a lock") & _c("target").isNotNull() & (_c("state_towards.callback") == "sync") & invokes & (_c("callback_lock_depth") > 0)


def _trusted_nullable(kind: Column) -> Column:
    return kind.startswith("rcu_ptr_or_null") | kind.startswith("ptr_or_null")


def nullable_use():
    helper = _says("helper arg")
    given = M.natural_after(_c("low"), "helper arg")
    reg = F.coalesce(F.when(given.between(1, 5), given.cast("int")), F.when(~helper, _REG()))
    first = F.get(I.mentioned(_c("tail")), F.lit(0))
    mismatch = F.when(helper, _c("target").isNull()).when(_says("invalid mem access"), F.coalesce(_BASE() != reg, F.lit(False))).when(_says("pointer arithmetic"), ~first.eqNullSafe(reg)).otherwise(False)
    kind = F.when(_c("site").isNotNull(), F.when(~mismatch, _kind(reg))).when(~helper, _kind(reg, "last"))
    return _obligation("NullablePointer") & _says_any("_or_null", "possibly null pointer") & ~_says("trusted arg") & kind.contains("_or_null") & ~_trusted_nullable(kind)


def trusted_nullable():
    named = M.natural_after(_c("low"), "trusted arg")
    reg = F.coalesce(named + 1, M.natural_after(_c("low"), "helper arg"), F.when(_obligation("Unknown") & (_c("target") == "bpf_kptr_xchg"), 2)).cast("int")
    kind = _kind(reg, "argument")
    return _c("target").isNotNull() & _trusted_nullable(kind) & (_says("trusted arg") | kind.startswith("rcu_ptr_or_null") | (_c("target") == "bpf_kptr_xchg"))


def kfunc_argument():
    expected = F.nullif(F.regexp_extract("low", r"expected pointer to struct ([^\s,;]*)", 1), F.lit(""))
    rcu, scalar = _says("must be a rcu pointer"), _says("pointer type struct", "must point to scalar")
    kind = _kind(F.coalesce(_REG(), M.argument_register_after(_c("message"), "arg#")), "argument")
    concerned = rcu | scalar | _says("kernel function", "expected pointer to struct", " but r")
    contract = _says("kernel function") | _any(*(_c("target").contains(x) for x in ("cgroup", "cpumask", "rbtree", "kptr")))
    wrong = F.when(rcu, ~kind.startswith("untrusted_ptr") & ~kind.startswith("rcu_ptr") & ~kind.startswith("trusted_ptr")).when(scalar, kind == "fp").otherwise(~kind.contains(expected))
    return concerned & _c("target").isNotNull() & contract & kind.isNotNull() & wrong


def type_contract():
    actual = F.regexp_replace(F.trim(F.regexp_extract("low", "type=(.*?) expected=", 1)), ",+$", "")
    expected = F.trim(F.regexp_extract("low", r"type=.*? expected=([^\n;]*)", 1))
    listed = F.array_contains(F.transform(F.split(expected, ","), lambda x: F.trim(x)), "map_ptr")
    known = ~_says("trusted arg") & (actual != "") & (expected != "") & ~actual.contains("_or_null") & ~((actual == "scalar") & listed)
    kind = F.try_element_at("regs", _REG())["argument"]["state"]["reg_type"]
    family = F.when(actual.isin("trusted_ptr_", "rcu_ptr_", "untrusted_ptr_"), kind.startswith(F.regexp_replace(actual, "_$", ""))).when(actual.endswith("_"), kind.startswith(actual)).otherwise(False)
    return _obligation("TypeContract") & _REG().between(1, 5) & known & _c("direct").isNotNull() & ((kind == actual) | family) & ~F.coalesce(_c("argument_rewritten"), F.lit(False))


def object_protocol():
    reg = F.coalesce(_REG(), M.argument_register_after(_c("low"), "args#"), M.argument_register_after(_c("low"), "arg#"), F.when((_c("target") == "bpf_kptr_xchg") & _says("has no valid kptr"), 1))
    kind, t = _kind(reg, "argument"), _c("target")
    concerned = t.startswith("bpf_cgroup_") | t.startswith("bpf_cpumask_") | t.isin("bpf_kptr_xchg", "bpf_dynptr_from_skb")
    pointer = kind.isin("fp", "scalar") | _any(*(kind.startswith(x) for x in ("ptr_", "rcu_ptr", "untrusted_ptr", "trusted_ptr")))
    wrong = (
        F.when(_says("has no valid kptr"), (t == "bpf_kptr_xchg") & kind.isin("map_value", "fp", "scalar"))
        .when(_says("must be a rcu pointer"), pointer & ~kind.startswith("rcu_ptr") & ~kind.startswith("trusted_ptr"))
        .when(_says("must be referenced or trusted"), pointer & ~kind.startswith("trusted_ptr") & ~kind.contains("ref_obj_id"))
        .when(_says("pointer type struct", "must point to scalar"), t.startswith("bpf_cgroup_") & (kind == "fp"))
        .when(_says("expected pointer to struct"), pointer)
        .when(_says("type=scalar expected=fp") | _says("memory, len pair leads to invalid memory access"), (t == "bpf_cpumask_populate") & (kind == "scalar")).otherwise(False)
    )
    return concerned & kind.isNotNull() & wrong


def _no_struct() -> Column:
    return F.exists("prior", lambda x: x.contains("type PTR is not a struct"))


def context_argument():
    return M.is_context_access(_c("message")) & _no_struct() & _c("rejected.text").contains("BPF_PROG(") & (_kind(1, "last") == "ctx")


def context_field():
    m = _c("message")
    fits = lambda mark, of: M.natural_after(m, mark).isNull() | (of == M.natural_after(m, mark))
    return M.is_context_access(m) & ~F.coalesce(_no_struct(), F.lit(False)) & _BASE().isNotNull() & F.coalesce(fits("size=", _c("width")), F.lit(False)) & F.coalesce(fits("off=", _c("off")), F.lit(False)) & (_kind(_BASE()) == "ctx")


def _scalar_origin() -> Column:
    """A scalar, used as a pointer, that was loaded from the context."""
    return _obligation("PointerProvenance") & _says_any(*_SCALAR_ACCESS) & (_BASE() == _REG()) & (_kind(_BASE(), "before_all") == "scalar") & (_c("origin.base_kind") == "ctx") & I.is_load(_c("origin.tail"))


_FIELDS = ("ctx->args", "ctx->envp", "ctx->argv", "ctx->filename")


def trace_context():
    texts = (_c("origin.source.text"), F.coalesce("site_source.text", "rejected.text"))
    direct = _any(*(F.coalesce(_any(*(t.contains(f) for f in _FIELDS)), F.lit(False)) for t in texts))
    typed = _any(*(F.coalesce(t.contains("PT_REGS_"), F.lit(False)) for t in texts))
    tracing = F.regexp_replace(_c("section"), r"^\?+", "").rlike(r"^(?:tracepoint/|tp/|raw_tracepoint/|raw_tp/|raw_tp$)")
    return _scalar_origin() & (direct | (typed & F.coalesce(tracing, F.lit(False))))


def packet_context():
    skb = F.regexp_replace(_c("section"), r"^\?+", "").rlike("^(?:tracepoint/skb/|tp/skb/)")
    return _scalar_origin() & skb & I.access_offset(_c("origin.tail")).isin(76, 80)


def kernel_field():
    m = _c("message")
    name = F.nullif(F.regexp_extract(m, r"access beyond struct (\w+)", 1), F.lit(""))
    of = lambda x: F.coalesce(M.natural_after(m, f"{x} "), M.natural_after(m, f"{x}="))
    plain = lambda c: F.regexp_replace(F.trim(c), "^struct ", "")
    return name.isNotNull() & (_c("off") == of("off")) & (_c("width") == of("size")) & (_kind(_BASE()) == F.concat(F.lit("ptr_"), name)) & (plain(_c("relocated_struct")) != plain(name))


def throw_with_reference():
    return (_c("target") == "bpf_throw") & (_c("state_until.callback") == "sync") & (_c("state_until.refs") > 0)


def reference_at_exit():
    ref = M.natural_after(_c("low"), "reference id=")
    return _obligation("ReferenceLifecycle", "Unknown") & _says("unreleased reference id=") & I.is_exit(_c("tail")) & F.array_contains("state_at.ref_ids", ref) & _c("reference_acquired")


def acquires_reference(target: Column) -> Column:
    """Whether a helper's name says that it hands out a reference."""
    return target.contains("_acquire") | target.contains("_create") | target.endswith("_new") | target.startswith("bpf_ringbuf_reserve") | target.isin("bpf_kptr_xchg", "bpf_obj_new")


def exception_callback():
    need = M.required_return_range(_c("message"))
    returned = _says("at program exit", "register r0", "should have been in") & R.outside(_c("validated_r0"), need["lo"], need["hi"])
    return F.when(_says("cannot call exception cb directly"), _c("exception_called")).otherwise(returned)


def map_key_unreadable():
    text = _c("rejected.text")
    once = F.size(F.split(text, "bpf_map_lookup_elem")) == 2
    return _c("message").contains("!read_ok") & (_REG() == 2) & _c("tail").contains("call bpf_map_lookup_elem#") & once & T.is_bare_identifier(T.call_argument(text, "bpf_map_lookup_elem", 1))


def _unreadable() -> Column:
    return _obligation("StackInitialized") & _c("message").contains("!read_ok") & (_REG() > 0) & _c("site").isNotNull() & _reg(_REG(), "before").isNull()


def entry_unreadable():
    return _unreadable() & (_REG() >= 2) & I.uses(_c("tail"), _REG()) & ~F.array_contains("entry_registers", _REG()) & (_c("multi_argument_entry") == 1)


def helper_argument_unreadable():
    return _unreadable() & (_c("target") == "bpf_skb_store_bytes") & (_REG() == 5)


def map_raw_access():
    return _obligation("HelperArgument") & _c("message").contains("only read from bpf_array is supported") & (_kind(_BASE(), "path") == "map_ptr")


def perf_output():
    return _obligation("HelperArgument") & _c("message").contains("helper access to the packet is not allowed") & (_c("target") == "bpf_perf_event_output") & _kind(4, "path").isin("pkt", "pkt_meta") & (_kind(5, "path") == "scalar")


def return_unreadable():
    return _obligation("StackInitialized") & _c("message").contains("!read_ok") & (_REG() == 0) & I.is_exit(_c("tail"))


def legacy_load():
    compact = F.regexp_replace("tail", r"\s", "")
    legacy = _c("tail").rlike(r"^\((?:20|28|30|40|48|50)\)") & compact.contains("=*(u") & compact.contains("*)skb[")
    return _obligation("StackInitialized") & _c("message").contains("!read_ok") & (_REG() == 6) & legacy & _c("path_frame").isNotNull() & _reg(6, "path").isNull()


def _stack_read_issue() -> Column:
    a, pair = M.stack_read(_c("message")), H.stack_read_pair(_c("target"))
    p = F.try_element_at("regs", pair.first)["path"]
    length = R.exact_scalar(_reg(pair.second, "path")).cast("long")
    return (
        _obligation("StackInitialized") & _says("read from stack", "memory, len pair") & (a["register"] == pair.first) & (_REG().isNull() | (_REG() == pair.first)) & (p["state"]["reg_type"] == "fp") & (p["source_frame"] == _c("path_frame"))
        & (a["size"] == length) & (a["delta"] >= 0) & (p["state"]["off"] == a["base"]) & (a["delta"] < length) & (length > F.coalesce("initialized", F.lit(0)))
    )


def stack_read_length():
    return _stack_read_issue() & (_c("initialized") > 0) & (M.stack_read(_c("message"))["delta"] >= _c("initialized"))


def stack_read_bytes():
    return _stack_read_issue()


def stack_write_beyond():
    w, pair = M.stack_write(_c("message")), H.writable_stack_output_pair(_c("target"))
    s = _reg(_REG(), "before")
    return _obligation("StackInitialized") & ~M.in_stack_frame(w) & (pair.first == _REG()) & (s["reg_type"] == "fp") & (s["off"] == w["start"]) & (R.exact_scalar(_reg(pair.second, "before")) == (w["end"] - w["start"]))


def scalar_as_pointer():
    by_access, by_end = M.is_scalar_access(_c("message")), M.is_pointer_arithmetic(_c("message")) & M.names_packet_end(_c("message"))
    first = F.get(I.mentioned(_c("tail")), F.lit(0))
    kind = _kind(_REG())
    return _obligation("PointerProvenance") & (by_access | by_end) & (~by_access | (_BASE() == _REG())) & (~by_end | (first == _REG())) & F.when(by_access, kind == "scalar").otherwise(kind == "pkt_end")


def prohibited_arithmetic():
    first = F.get(I.mentioned(_c("tail")), F.lit(0))
    return _obligation("PointerProvenance") & M.is_pointer_arithmetic_or_bitwise(_c("message")) & ~M.names_packet_end(_c("message")) & (first == _REG()) & (_kind(_REG()) != "scalar")


def null_scalar():
    return _obligation("PointerProvenance") & M.is_scalar_access(_c("message")) & (_BASE() == _REG()) & R.is_zero(_reg(_REG(), "before_all")) & (F.coalesce(_c("origin.null_return"), F.lit(False)) | F.coalesce(_c("refined_to_zero"), F.lit(False)) | F.coalesce(_c("overwritten_with_zero"), F.lit(False)))


def packet_without_proof():
    m = _c("message")
    s, need = F.coalesce(_reg(_REG(), "before_all"), _reg(_REG(), "before")), M.packet_required(_c("message"))
    reported = M.signed_after(m, "off=")
    placed = lambda off: reported.isNull() | (_offset(s) + off == reported)
    sized = M.natural_after(m, "size=").isNull() | (_c("width") == M.natural_after(m, "size="))
    shape = F.when(_BASE().isNotNull(), (_BASE() == _REG()) & sized & placed(_c("off"))).otherwise((_c("direct") == "bpf_csum_diff") & _REG().isin(1, 3) & placed(F.lit(0)))
    told = M.natural_after(m, "r=")
    return _obligation("PacketBounds") & _c("site").isNotNull() & (s["reg_type"] == "pkt") & shape & (told.isNull() | (told == s["packet_range"])) & (s["packet_range"] < need)


def _event(role: str, evidence: str, obligation: str, source=None) -> Column:
    def fits(e: Column) -> Column:
        kind = (e["role"] == role) & (e["evidence"] == evidence) & (e["obligation"] == obligation)
        return kind if source is None else kind & F.coalesce(source(e["source"]["text"]), F.lit(False))

    return F.exists("events", fits)


def packet_pointer_lost():
    return _event("lost", "state", "PointerProvenance", T.is_packet_check)


def packet_range_lost():
    return _event("established", "state", "PacketBounds", lambda t: T.is_packet_derivation(t) | T.is_packet_check(t)) & _event("lost", "state", "PacketBounds")


def packet_guard_short():
    return _obligation("PacketBounds") & _reg(_REG(), "last").isNotNull() & ~_event("established", "state", "PacketBounds") & _event("lost", "state", "PacketBounds", T.is_packet_check) & _c("lost_guard_covers")


def packet_precision():
    s, need = _reg(_REG(), "last"), M.packet_required(_c("message"))
    fixed, variable = F.when(s["off"] >= 0, s["off"]), R.variable_offset_max(s)
    reaches = F.coalesce(fixed, F.lit(0)) + variable + need > 0xFFFF
    relative = need - fixed
    number = T.largest_number(F.col("packet_check.source.text"))
    guard = _c("guard_covers") & ((number >= need) | ((relative > 0) & ((number >= relative) | ((relative <= 1) & F.col("packet_check.source.text").contains("sizeof(")))))
    proven = F.exists("events", lambda e: (e["role"] == "established") & (e["evidence"] == "state") & e["source"].eqNullSafe(_c("rejected")))
    return _obligation("PacketBounds") & (s["reg_type"] == "pkt") & (s["packet_range"] == 0) & reaches & _event("established", "source", "PacketBounds", T.is_packet_check) & (F.coalesce(guard, F.lit(False)) | proven)


def map_relation_precision():
    a, pair = _c("access"), H.map_value_access_pair(_c("direct"))
    s, length = _reg(pair.first, "before_all"), _reg(pair.second, "before_all")
    exceeds = R.access_may_exceed(s, a["size"]) | (M.wider_than_value(a) & _any(*(F.coalesce(length[b] == a["size"], F.lit(False)) for b in ("exact", "umax", "smax", "umax32", "smax32"))))
    return _obligation("ScalarRange") & M.ends_behind_value(a) & _map_state("before_all", pair.first) & R.remaining(a["value_size"], s["off"]).isNotNull() & _c("relation_source") & exceeds


def map_guard_exceeds():
    a, s = _c("access"), _reg(_REG(), "last")
    room = a["value_size"] - (_offset(s) + _c("off")) - a["size"]
    index = F.nullif(F.trim(F.regexp_extract("rejected.text", r"\[([^\[\]]*)\][^\[]*$", 1)), F.lit(""))
    guard = F.col("scalar_guard.source.text")
    return ~M.wider_than_value(a) & _map_state("last", _REG()) & (_offset(s) + _c("off") >= 0) & (room >= 0) & (R.variable_offset_max(s) > room) & T.is_bare_identifier(index) & (T.guard_bound(guard, index) > room) & (F.col("scalar_guard.pc") < _c("pc")) & _c("guard_added")


def stale_packet():
    return _obligation("PointerProvenance") & M.is_scalar_access(_c("message")) & (_BASE() == _REG()) & _c("packet_invalidated")


def stale_dynptr():
    return _obligation("PointerProvenance") & M.is_scalar_access(_c("message")) & (_BASE() == _REG()) & ~F.coalesce(_c("packet_invalidated"), F.lit(False)) & _c("dynptr_invalidated")


def opaque_pointer():
    return _obligation("PointerProvenance") & M.is_scalar_access(_c("message")) & (_BASE() == _REG()) & (_kind(_REG(), "before_all") == "scalar") & _c("probe_read_value")


PREDICATES = {
    "WideStackAlignment": wide_stack_alignment, "AtomicMemoryAccessScalarBase": atomic_scalar_base, "LoopBackEdgeStateRepeats": loop_repeats, "SharedInstructionPointerMerge": pointer_merge, "SharedInstructionPathProofLoss": path_proof_loss,
    "Alu32PointerCopyDropsProvenance": alu32_copy, "ConstantScalarMemoryLoad": constant_load, "SharedInstructionUninitializedRegister": uninitialized_shared, "PointerShiftDropsProvenance": pointer_shift, "ModifiedContextPointer": modified_context,
    "SubprogramContextArgumentDropped": dropped_context_argument, "PacketPointerProofLostAfterBoundsCheck": packet_pointer_lost, "PacketRangeProofLostBeforeAccess": packet_range_lost, "PacketAccessWithoutBoundsProof": packet_without_proof,
    "MapValueWideAccess": map_wide_access, "MapValueCheckedOffsetRelationLost": map_offset_lost, "MapValueGuardExceedsValueSize": map_guard_exceeds, "MapValueAccessOutOfBounds": map_out_of_bounds, "MemoryObjectAccessOutOfBounds": memory_out_of_bounds,
    "ReturnRangeOutOfBounds": return_out_of_range, "StackVariableOffsetOutOfBounds": stack_variable_offset, "ScalarRangeUnsafeAtUse": scalar_unsafe, "MapPointerArgumentScalarZero": map_argument_zero, "BtfFuncInfoMissing": func_info_missing,
    "SubprogramReferenceMetadataMissing": subprogram_reference, "DynptrStackStorageAccess": dynptr_storage, "DynptrUninitializedArgument": dynptr_uninitialized, "DynptrReferencedSlotOverwrite": dynptr_overwrite, "DynptrReadonlyPacketWrite": dynptr_readonly_write,
    "DynptrStackSlotWriteOverlap": dynptr_write_overlap, "DynptrHelperArgumentStateMismatch": dynptr_argument_mismatch, "DynptrReleaseUnacquiredReference": dynptr_unacquired, "DynptrSliceVariableLength": dynptr_slice_length,
    "IteratorStackStorageAccess": iterator_storage, "IteratorHelperArgumentStateMismatch": iterator_argument, "IrqFlagStateMismatch": irq_flag, "IrqRestoreOrderMismatch": irq_order, "IrqRestoreHelperClassMismatch": irq_class, "IrqStateLiveAtExit": irq_at_exit,
    "SleepableCallInNonSleepableContext": sleepable_call, "CallbackCallWhileLocked": callback_locked, "NullablePointerUseWithoutProof": nullable_use, "NullScalarDereferenceAfterPointerProof": null_scalar, "TrustedNullableArgument": trusted_nullable,
    "KfuncArgumentTypeMismatch": kfunc_argument, "VerifierTypeContractMismatch": type_contract, "ModernBpfObjectProtocolViolation": object_protocol, "ContextAccessSourceArgumentMismatch": context_argument, "TraceContextScalarArgumentMismatch": trace_context,
    "ContextFieldUnavailable": context_field, "PacketContextFieldAccessInUnsupportedProgram": packet_context, "KernelObjectFieldAccessMismatch": kernel_field, "ExceptionThrowWithLiveReference": throw_with_reference, "ReferenceLiveAtExit": reference_at_exit,
    "ExceptionCallbackProtocolViolation": exception_callback, "MapLookupKeyArgumentUnreadable": map_key_unreadable, "UnreadableProgramEntryArgument": entry_unreadable, "UnreadableHelperArgument": helper_argument_unreadable,
    "MapPointerRawAccessContract": map_raw_access, "PerfEventOutputPacketAccess": perf_output, "UnreadableReturnRegister": return_unreadable, "LegacySkbLoadUnreadableRegister": legacy_load, "HelperStackReadLengthExceedsInitializedRange": stack_read_length,
    "HelperStackReadExceedsInitializedRange": stack_read_bytes, "HelperStackWriteBeyondFrame": stack_write_beyond, "ScalarValueUsedAsPointer": scalar_as_pointer, "OpaqueScalarPointerDereference": opaque_pointer,
    "StalePointerAfterInvalidatingHelper": stale_packet, "DynptrDataPointerInvalidatedBeforeUse": stale_dynptr, "ProhibitedPointerArithmetic": prohibited_arithmetic, "PacketGuardUndercoversAccess": packet_guard_short,
    "PacketMaxOffsetPrecisionBoundary": packet_precision, "MapValueRelationPrecisionBoundary": map_relation_precision,
}

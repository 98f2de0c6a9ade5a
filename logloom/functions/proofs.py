"""What each proof obligation asks for and why it was rejected: dimension texts, and texts with the values of a message.

Obligations are named as in `operators.classify`. All texts are the output format of diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import messages as M
from . import ranges as R
from .binding import let

# Obligation, label, next action, required proof, rejection.
OBLIGATIONS = (
    ("PacketBounds", "packet bounds", "prove that the packet pointer plus requested access size stays before data_end on every path reaching the load, store, or helper call", "rejected here: packet access is not proven to stay before data_end"),
    ("PointerProvenance", "pointer provenance", "preserve a verifier-recognized pointer type at the operation that requires a pointer", "rejected here: verifier sees a scalar where a pointer is required"),
    ("ScalarRange", "scalar range", "bound the scalar value tightly enough for the verifier to prove the memory access range", "rejected here: scalar range is not proven safe for this memory operation"),
    ("NullablePointer", "nullable pointer", "prove that the nullable pointer returned by a helper is checked for null before dereference or helper reuse", "rejected here: nullable pointer is used without a visible non-null proof"),
    ("StackInitialized", "stack initialization", "initialize every stack byte that can be read directly or passed indirectly to a helper", "rejected here: stack bytes are not proven initialized"),
    ("ReferenceLifecycle", "reference lifecycle", "release every acquired verifier-tracked reference on every exit path", "rejected here: reference is not proven released on all paths"),
    ("Alignment", "alignment", "prove that the stack, packet, or map-value address has the alignment required for this access size", "rejected here: memory access alignment is not proven"),
    ("TypeContract", "type contract", "preserve the pointer, frame-pointer, map, packet, trusted, or other verifier-visible type required by this instruction or helper argument", "rejected here: verifier-visible value type does not match this operation"),
    ("HelperArgument", "helper/subprogram argument", "pass verifier-recognized argument types, ranges, and pointer lifetimes to the helper, kfunc, or subprogram", "rejected here: helper or subprogram argument contract is not satisfied"),
    ("ContextAccess", "context/struct access", "access only fields and offsets that are valid for the verifier-visible context or kernel struct type", "rejected here: requested context or kernel-struct field is not available"),
    ("VerifierLimit", "verifier limit", "reduce verifier state growth or provide a statically bounded loop shape", "rejected here: verifier analysis budget or loop proof is exhausted"),
    ("EnvironmentCapability", "environment/capability", "load the program with a kernel, program type, attach point, and privileges that support the requested helper or kfunc", "rejected here: kernel or program type does not expose this capability"),
    ("DynptrSafety", "dynptr safety", "keep dynptr helper arguments on valid dynptr stack slots with live state, supported mode, and proven access length", "rejected here: dynptr helper argument violates the verifier's dynptr protocol"),
    ("KfuncReference", "kfunc/reference", "satisfy the kfunc trusted argument, nullability, and acquire/release contract on every path", "rejected here: kfunc trusted-pointer or reference contract is not satisfied"),
    ("IteratorLifecycle", "iterator lifecycle", "keep iterator state inside the verifier-approved create, next, and destroy lifecycle", "rejected here: iterator lifecycle proof is missing"),
    ("LockState", "lock/RCU/IRQ state", "preserve the verifier-required ordering for lock, RCU, or IRQ state acquire and release operations", "rejected here: lock, RCU, or IRQ state discipline is violated"),
    ("InstructionSupport", "instruction support", "use a kernel, JIT configuration, and compiler target that support the generated BPF instruction stream", "rejected here: kernel or JIT does not support this instruction or feature"),
    ("LoopBound", "loop bound", "make the loop bound statically visible and small enough for the verifier", "rejected here: loop bound proof is missing"),
    ("Unknown", "verifier proof", "inspect the terminal verifier line and add the missing safety proof required at that program point", "rejected here: required verifier proof is missing"),
)
# For dynptr messages, what the message contains (any of), and the texts with and without the argument's name;
# {arg} and {helper} are filled in. The first that fits counts.
DYNPTR_CASES = (
    (("unacquired reference",), "release or discard dynptr-backed references only while they are acquired, exactly once; {arg} is not acquired at {helper}", "rejected here: {arg} is an unacquired dynptr-backed reference at this helper call", "release or discard dynptr-backed references only while they are acquired, exactly once before calling {helper}", "rejected here: dynptr-backed reference is not acquired at this helper call"),
    (("expected an initialized dynptr",), "pass the exact initialized dynptr stack slot as {arg}; avoid interior pointers such as &ptr + offset or overwritten dynptr storage", "rejected here: {arg} is not the exact initialized dynptr stack slot expected by this helper", "pass the exact initialized dynptr stack slot to the helper; avoid interior pointers such as &ptr + offset or overwritten dynptr storage", "rejected here: helper argument is not the exact initialized dynptr stack slot"),
    (("dynptr has to be an uninitialized dynptr",), None, None, "pass a clean dynptr stack slot at the exact declared address to the initializer helper; do not pass an interior or already-initialized dynptr slot", "rejected here: dynptr initializer did not receive an uninitialized dynptr stack slot"),
    (("cannot pass in dynptr at an offset", "dynptr has to be at a constant offset", "expected pointer to stack or const struct bpf_dynptr"), "pass the exact dynptr stack slot address as {arg} at a verifier-visible constant offset, not an interior or variable pointer", "rejected here: {arg} points inside or variably around the dynptr stack slot", "pass the exact dynptr stack slot address at a verifier-visible constant offset, not an interior or variable pointer", "rejected here: helper argument points inside or variably around the dynptr stack slot"),
    (("cannot overwrite referenced dynptr",), None, None, "do not overwrite or reinitialize a dynptr stack slot while verifier-tracked dynptr state is still live", "rejected here: live referenced dynptr state would be overwritten"),
    (("expected a dynptr of type",), None, None, "pass a dynptr with the helper-required backing type and read/write mode", "rejected here: dynptr backing type or mode does not match this helper"),
    (("must be a known constant",), None, None, "pass a verifier-known constant length to the dynptr slice helper, or split variable-length handling into verifier-visible constant-size cases", "rejected here: dynptr slice length is not a verifier-known constant"),
    (("does not allow writes to packet data",), None, None, "use a read-only dynptr slice helper in this program context, or move the write path to a hook where packet writes are allowed", "rejected here: read-write dynptr access is not allowed for this packet context"),
    (("potential write to dynptr",), None, None, "keep ordinary writes and helper outputs away from stack bytes that store live dynptr state", "rejected here: write may clobber verifier-tracked dynptr storage"),
)


def dimension(spark: SparkSession) -> DataFrame:
    """(obligation, label, required, rejected): nineteen rows, for broadcast joins."""
    return spark.createDataFrame(list(OBLIGATIONS), "obligation string, label string, required string, rejected string")


def _of(obligation: Column, k: int) -> Column:
    out = F.lit(OBLIGATIONS[-1][k])
    for row in reversed(OBLIGATIONS[:-1]):
        out = F.when(obligation == row[0], F.lit(row[k])).otherwise(out)
    return out


def label(obligation: Column) -> Column:
    return _of(obligation, 1)


def default_required(obligation: Column) -> Column:
    return _of(obligation, 2)


def default_rejected(obligation: Column) -> Column:
    return _of(obligation, 3)


def _default(name: str) -> tuple[Column, Column]:
    row = next(r for r in OBLIGATIONS if r[0] == name)
    return F.lit(row[2]), F.lit(row[3])


def _text(*parts) -> Column:
    """The parts joined; null if one is."""
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def _pair(required: Column, rejected: Column) -> Column:
    return F.struct(required.alias("required"), rejected.alias("rejected"))


def _first(name: str, required: list[Column], rejected: list[Column]) -> Column:
    """The first text of each that has all its values; the obligation's own otherwise."""
    own = _default(name)
    return _pair(F.coalesce(*required, own[0]), F.coalesce(*rejected, own[1]))


def packet_bounds(message: Column, reg: Column) -> Column:
    """Bytes that the access needs against those that the message says are proven."""

    def texts(x: Column) -> Column:
        need, known = x["need"], x["known"]
        r = _text("R", reg)
        return _first("PacketBounds",
                      [_text("prove ", r, " has packet range at least ", need, " bytes before this access; verifier currently has range ", known), _text("prove ", r, " has packet range at least ", need, " bytes before this access")],
                      [_text("rejected here: verifier needs ", r, " packet range >= ", need, ", but only ", known, " bytes are proven"), _text("rejected here: verifier needs ", r, " packet range >= ", need, " before this access")])

    return let(F.struct(M.packet_required(message).alias("need"), M.signed_after(message, "r=").alias("known")), texts)


def scalar_range(message: Column, reg: Column, state: Column) -> Column:
    """`state` is the register's last one (null if unknown)."""
    r, seen = _text("R", reg), F.when(state.isNotNull(), R.summary(state))
    before = " has a bounded non-negative scalar range before this pointer arithmetic or helper memory access"
    found = _first("ScalarRange",
                   [F.when(message.contains("value -"), F.lit("prove the scalar used for pointer arithmetic cannot be negative on any path")), _text("prove ", r, before, "; verifier sees ", seen), _text("prove ", r, before)],
                   [_text("rejected here: verifier still sees ", r, " as ", seen), _text("rejected here: ", r, " is not proven to have a safe scalar range")])
    return F.when(M.has(message, "invalid access to map value"), map_value(message, reg, state)).otherwise(found)


def map_value(message: Column, reg: Column, state: Column) -> Column:
    """The byte range of an access against the size of the map's value."""

    def texts(x: Column) -> Column:
        size_of, off, size, r = F.coalesce(x["value_size"], state["map_value_size"].cast("long")), x["off"], x["size"], _text("R", reg)
        seen = F.when(state.isNotNull(), R.value_summary(state))
        span = _text("prove ", r, "'s map-value byte range off=", off, " size=", size, " stays within value_size=", size_of)
        offset = _text("prove ", r, "'s computed map-value offset stays within value_size=", size_of)
        return _first("ScalarRange", [_text(span, "; verifier sees ", seen), span, _text(offset, "; verifier sees ", seen), offset],
                      [_text("rejected here: ", r, " map-value access off=", off, " size=", size, " reaches byte ", F.try_add(off, size), ", past value_size=", size_of), _text("rejected here: ", r, " map-value offset is not proven within value_size=", size_of)])

    return let(F.struct(*(M.signed_after(message, f"{n}=").alias(n) for n in ("value_size", "off", "size"))), texts)


def nullable(message: Column, reg: Column) -> Column:
    r = _text("R", reg)
    return _first("NullablePointer", [_text("prove ", r, " is non-null in the same verifier-visible branch before dereference, pointer arithmetic, or helper reuse")],
                  [F.when(message.contains("pointer arithmetic"), _text("rejected here: ", r, " is still nullable, so pointer arithmetic is prohibited")), _text("rejected here: ", r, " is still nullable at the use site")])


def stack(message: Column, reg: Column) -> Column:
    r, unread = _text("R", reg), message.contains("!read_ok")
    return _first("StackInitialized", [F.when(unread, _text("write a readable value to ", r, " on every path before this return or helper use")), _text("initialize every stack byte reachable from ", r, " before it is read or passed to a helper")],
                  [F.when(unread, _text("rejected here: ", r, " is not readable on this path")), _text("rejected here: stack memory reachable from ", r, " is not fully initialized")])


def reference(message: Column) -> Column:
    return let(F.coalesce(M.signed_after(message, "id="), M.signed_after(message, "ref_obj_id=")),
               lambda i: _first("ReferenceLifecycle", [_text("release verifier-tracked reference id ", i, " on every path before exit")], [_text("rejected here: reference id ", i, " is not released on every path")]))


def environment(message: Column) -> Column:
    return let(M.helper(message), lambda h: _first("EnvironmentCapability", [_text("load this program with an attach type and kernel environment that allow ", h, ", or avoid that helper on this path")], [_text("rejected here: this program type cannot use ", h)]))


def dynptr(message: Column, call_target: Column) -> Column:
    """By what the message says of the dynptr; the first case that fits."""

    def texts(x: Column) -> Column:
        def filled(template: str | None) -> Column:
            if template is None:
                return F.lit(None).cast("string")
            return F.replace(F.replace(F.lit(template), F.lit("{arg}"), x["arg"]), F.lit("{helper}"), x["helper"])

        plain = F.struct(x["helper"].alias("helper"), F.lit("").alias("arg"))
        own = _default("DynptrSafety")
        required, rejected = own
        for needles, with_arg, no_with_arg, without, no_without in reversed(DYNPTR_CASES):
            fits = M.has_any(message, *needles)
            alone = lambda t: F.replace(F.lit(t), F.lit("{helper}"), plain["helper"])
            required = F.when(fits, F.coalesce(filled(with_arg), alone(without))).otherwise(required)
            rejected = F.when(fits, F.coalesce(filled(no_with_arg), alone(no_without))).otherwise(rejected)
        return _pair(required, rejected)

    helper = F.when(call_target.contains("dynptr"), call_target).otherwise("this dynptr helper")
    return let(F.struct(_text("arg #", M.argument(message)).alias("arg"), helper.alias("helper")), texts)


def required_proof(message: Column, call_target: Column, obligation: Column, reg: Column, state: Column) -> Column:
    """(required, rejected): the texts of an obligation with the values of its message and of the register's state."""
    own = _pair(default_required(obligation), default_rejected(obligation))
    return (
        F.when(obligation == "PacketBounds", packet_bounds(message, reg)).when(obligation == "ScalarRange", scalar_range(message, reg, state)).when(obligation == "NullablePointer", nullable(message, reg))
        .when(obligation == "StackInitialized", stack(message, reg)).when(obligation == "ReferenceLifecycle", reference(message)).when(obligation == "DynptrSafety", dynptr(message, call_target))
        .when(obligation == "EnvironmentCapability", environment(message)).otherwise(own)
    )

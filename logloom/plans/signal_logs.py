"""Whole logs that show one proof signal each, and the query that explains one of them for each order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signals as N
from ..operators import diagnose, logs
from . import projections as P

HEAD = "func#0 @0\n0: R1=ctx() R10=fp0\n"
LOGS = {
    "WideStackAlignment": "0: (bf) r2 = r10 ; R2_w=fp0\n1: (07) r2 += -12 ; R2_w=fp-12\n2: (79) r3 = *(u64 *)(r2 +0)\nmisaligned stack access off (0x0; 0x0)+-12+0 size 8",
    "AtomicMemoryAccessScalarBase": "1: (79) r2 = *(u64 *)(r1 +0) ; R2_w=scalar()\n2: (db) lock *(u64 *)(r2 +0) += r3\nmisaligned access off (0x0; 0x0)+0 size 8",
    "LoopBackEdgeStateRepeats": "5: (05) goto pc-3\ninfinite loop detected at insn 3\ncur state: R0=1 R1=ctx() R10=fp0 fp-8=mmmmmmmm\nold state: R1=ctx() R0=1 fp-8=mmmmmmmm R10=fp0",
    "PointerShiftDropsProvenance": "; x = 1; @ a.c:1\n1: (bf) r2 = r1 ; R2_w=pkt(r=8)\n2: (67) r2 <<= 8\nR2 pointer arithmetic with <<= operator prohibited",
    "ModifiedContextPointer": "1: (07) r1 += 8 ; R1_w=ctx(off=8)\n2: (61) r2 = *(u32 *)(r1 +0)\ndereference of modified ctx ptr R1 off=8 disallowed",
    "SharedInstructionPointerMerge": "2: R2=map_value(vs=8)\n2: (79) r3 = *(u64 *)(r2 +0)\n2: R2=pkt(r=8)\n2: (79) r3 = *(u64 *)(r2 +0)\nsame insn cannot be used with different pointers",
    "SharedInstructionPathProofLoss": "2: R2=pkt(r=8)\n2: (79) r3 = *(u64 *)(r2 +0)\n2: R2=scalar()\n2: (79) r3 = *(u64 *)(r2 +0)\nR2 invalid mem access 'scalar'",
    "Alu32PointerCopyDropsProvenance": "1: (bc) w2 = w3 ; R2_w=scalar() R3=pkt(r=8)\n2: (79) r3 = *(u64 *)(r2 +0)\nR2 invalid mem access 'scalar'",
    "ConstantScalarMemoryLoad": "1: (b7) r2 = 16 ; R2_w=16\n2: (79) r3 = *(u64 *)(r2 +0)\nR2 invalid mem access 'scalar'",
    "PacketAccessWithoutBoundsProof": "; if (data + 14 > data_end) @ x.c:10\n0: (61) r2 = *(u32 *)(r1 +0) ; R2_w=pkt(r=0)\n; x = data[20]; @ x.c:12\n1: (71) r3 = *(u8 *)(r2 +20)\ninvalid access to packet, off=20 size=1, R2(id=0,off=20,r=0)\nR2 offset is outside of the packet",
    "MapValueWideAccess": "1: R2=map_value(ks=4,vs=4)\n2: (79) r3 = *(u64 *)(r2 +0)\ninvalid access to map value, value_size=4 off=0 size=8, R2 min value is outside",
    "MapValueAccessOutOfBounds": "; v = 1; @ a.c:3\n1: R2=map_value(off=4,ks=4,vs=8)\n2: (79) r3 = *(u64 *)(r2 +0)\ninvalid access to map value, value_size=8 off=4 size=8 R2 bad",
    "MemoryObjectAccessOutOfBounds": "1: R2=rdonly_mem(mem_size=8)\n2: (79) r3 = *(u64 *)(r2 +4)\ninvalid access to memory, mem_size=8 off=4 size=8 R2 min value is outside of the allowed memory range",
    "ReturnRangeOutOfBounds": "1: (b7) r0 = 7 ; R0_w=7\n2: (95) exit\nAt program exit the register R0 has value 7 should have been in [0, 1]",
    "StackVariableOffsetOutOfBounds": "1: R2=fp(off=-16,smin=0,smax=40,var_off=(0x0; 0x3f))\n2: (71) r3 = *(u8 *)(r2 +0)\ninvalid unbounded variable-offset read from stack R2",
    "ScalarRangeUnsafeAtUse": "1: R2=scalar(smin=-5)\n2: (85) call bpf_probe_read#4\nR2 min value is negative, either use unsigned or 'var &= const'",
    "BtfFuncInfoMissing": "func#1 @8\n1: (85) call pc+3\nmissing btf func_info",
    "NullablePointerUseWithoutProof": "1: (85) call bpf_map_lookup_elem#1 ; R0_w=map_value_or_null(id=1,ks=4,vs=8)\n2: (79) r3 = *(u64 *)(r0 +0)\nR0 invalid mem access 'map_value_or_null'",
    "NullScalarDereferenceAfterPointerProof": "; p = x @ a.c:1\n1: R2=map_value(ks=4,vs=8)\n2: (b7) r2 = 0 ; R2_w=0\n3: (79) r3 = *(u64 *)(r2 +0)\nR2 invalid mem access 'scalar'",
    "TrustedNullableArgument": "1: R2=rcu_ptr_or_null_task(id=1)\n2: (85) call bpf_task_acquire#9\nPossibly NULL pointer passed to trusted arg1",
    "KfuncArgumentTypeMismatch": "1: R1=ptr_task()\n2: (85) call bpf_rbtree_first#9\nR1 must be a rcu pointer kfunc",
    "VerifierTypeContractMismatch": "1: R2=scalar()\n2: (85) call bpf_map_update_elem#2\nR2 type=scalar expected=fp, pkt",
    "ModernBpfObjectProtocolViolation": "1: R1=ptr_cgroup()\n2: (85) call bpf_cgroup_release#9\nR1 must be referenced or trusted",
    "ContextFieldUnavailable": "1: (61) r2 = *(u32 *)(r1 +200)\ninvalid bpf_context access off=200 size=4",
    "KernelObjectFieldAccessMismatch": "1: R2=ptr_inet_sock()\n2: (61) r3 = *(u32 *)(r2 +798)\naccess beyond struct inet_sock at off 798 size 4",
    "ExceptionThrowWithLiveReference": "1: R0=1 cb refs=2\n2: (85) call bpf_throw#9\ncannot call bpf_throw with reference",
    "ReferenceLiveAtExit": "1: (85) call bpf_ringbuf_reserve#131 ; R0_w=ringbuf_mem(ref_id=2,sz=8) refs=2\n2: (95) exit ; refs=2\nUnreleased reference id=2 alloc_insn=1",
    "UnreadableReturnRegister": "1: (95) exit\nR0 !read_ok",
    "UnreadableHelperArgument": "1: (85) call bpf_skb_store_bytes#9\nR5 !read_ok",
    "UnreadableProgramEntryArgument": "; int f(struct a *x, int y) @ a.c:1\n0: (bf) r6 = r2\nR2 !read_ok",
    "MapPointerRawAccessContract": "1: R2=map_ptr(ks=4,vs=8)\n2: (79) r3 = *(u64 *)(r2 +0)\nonly read from bpf_array is supported; invalid argument",
    "PerfEventOutputPacketAccess": "1: R4=pkt(r=8) R5=scalar(umax=8)\n2: (85) call bpf_perf_event_output#25\nhelper access to the packet is not allowed",
    "HelperStackReadExceedsInitializedRange": "1: R3=fp-16 R4=16 fp-16=mmmmmmmm\n2: (85) call bpf_dynptr_slice#9\ninvalid read from stack R3 off -16+4 size 16\nmemory, len pair leads to invalid memory access",
    "HelperStackWriteBeyondFrame": "1: R1=fp-600 R2=16\n2: (85) call bpf_get_current_comm#16\ninvalid write to stack R1 off=-600 size=16",
    "ProhibitedPointerArithmetic": "; x @ a.c:2\n1: R2=pkt(r=8)\n2: (57) r2 &= 8\nR2 bitwise operator &= on pointer prohibited",
    "ScalarValueUsedAsPointer": "; x @ a.c:2\n1: R2=scalar()\n2: (79) r3 = *(u64 *)(r2 +0)\nR2 invalid mem access 'scalar'",
    "DynptrStackStorageAccess": "1: R2=fp-16 fp-8=dynptr_ringbuf(ref_id=2) fp-16=dynptr_ringbuf(ref_id=2) refs=2\n2: (79) r3 = *(u64 *)(r10 -16)\ninvalid read from stack off -16+0 size 8",
    "DynptrUninitializedArgument": "1: R1=fp-32 fp-8=mmmmmmmm\n2: (85) call bpf_dynptr_data#203\nExpected an initialized dynptr as arg #0",
    "DynptrReferencedSlotOverwrite": "1: R4=fp-16 fp-16=dynptr_ringbuf(ref_id=2) refs=2\n2: (85) call bpf_ringbuf_reserve_dynptr#198\ncannot overwrite referenced dynptr",
    "DynptrHelperArgumentStateMismatch": "1: R4=map_value(ks=4,vs=8)\n2: (85) call bpf_ringbuf_reserve_dynptr#198\ndynptr arg is bad",
    "DynptrSliceVariableLength": "1: R4=scalar(umax=9)\n2: (85) call bpf_dynptr_slice#9\nR4 must be a known constant",
    "IteratorStackStorageAccess": "1: R1=ctx() fp-8=iter_num(ref_id=1,state=active) refs=1\n2: (79) r3 = *(u64 *)(r10 -8)\ninvalid read from stack off -8+0 size 8",
    "IteratorHelperArgumentStateMismatch": "1: R1=fp-8 fp-8=mmmmmmmm\n2: (85) call bpf_iter_num_next#9\nexpected an initialized iter_num as arg #0",
    "IrqFlagStateMismatch": "1: R1=fp-8 fp-8=mmmmmmmm\n2: (85) call bpf_local_irq_restore#9\narg#0 expected an initialized irq flag",
    "IrqStateLiveAtExit": "1: (85) call bpf_local_irq_save#9 ; R0=1 refs=3 fp-8=ffffffff\n2: (95) exit ; refs=3\nBPF_EXIT instruction in main prog cannot be used inside bpf_local_irq_save-ed region",
    "SleepableCallInNonSleepableContext": "1: (85) call bpf_rcu_read_lock#9\n2: (85) call bpf_copy_from_user#148\nkernel func may sleep in non-sleepable context",
    "CallbackCallWhileLocked": "1: (85) call bpf_spin_lock#93\n2: (85) call bpf_rbtree_add#9\nfrom 2 to 5: frame1: R1=scalar() R10=fp0 cb\n5: frame1: R1=scalar() cb\n5: (85) call f#9\nfunction calls are not allowed while holding a lock",
    "StalePointerAfterInvalidatingHelper": "; x @ a.c:2\n1: R6=pkt(r=8)\n2: (85) call bpf_skb_pull_data#39 ; R0_w=scalar()\n3: R6=scalar()\n3: (71) r3 = *(u8 *)(r6 +0)\nR6 invalid mem access 'scalar'",
    "OpaqueScalarPointerDereference": "; x @ a.c:2\n1: R1=fp-8 R2=8\n2: (85) call bpf_probe_read_kernel#113 ; R0_w=scalar()\n3: (79) r6 = *(u64 *)(r10 -8) ; R6_w=scalar()\n4: (71) r3 = *(u8 *)(r6 +0)\nR6 invalid mem access 'scalar'",
    "TraceContextScalarArgumentMismatch": "; x = ctx->args[0]; @ a.c:2\n1: (79) r6 = *(u64 *)(r1 +16) ; R6_w=scalar()\n; y = *x; @ a.c:3\n2: (71) r3 = *(u8 *)(r6 +0)\nR6 invalid mem access 'scalar'",
    "ContextAccessSourceArgumentMismatch": "; int BPF_PROG(f, int *p) @ a.c:2\n1: (79) r6 = *(u64 *)(r1 +16)\nfunc 'g' arg0 type PTR is not a struct\ninvalid bpf_context access off=16 size=8",
    "MapLookupKeyArgumentUnreadable": "; v = bpf_map_lookup_elem(&m, key); @ a.c:2\n1: R1=map_ptr(ks=4,vs=8)\n2: (85) call bpf_map_lookup_elem#1\nR2 !read_ok",
    "MapPointerArgumentScalarZero": '; struct x mm SEC(".maps"); @ a.c:1\n0: (b7) r1 = 0 ; R1_w=0\n; v = bpf_map_lookup_elem(&mm, &key); @ a.c:9\n1: (85) call bpf_map_lookup_elem#1\nR1 type=scalar expected=map_ptr',
    "none, class only": "1: (61) r2 = *(u32 *)(r1 +0)\nmisaligned value access off (0x0; 0x0)+1+2 size 4",
    "malformed": "1: R2=foo(bar\n2: (79) r3 = *(u64 *)(r2 +0)\nR2 invalid mem access 'scalar'",
}
RELOCATED = "libbpf: loading object 'x'\nlibbpf: prog 'p': relo #0: <byte_off> [1] struct sock.sk_hash\nlibbpf: prog 'p': relo #0: patched insn #2 (LDX) off 798 -> 798\nlibbpf: prog 'p': -- BEGIN PROG LOAD LOG --\n"


def texts() -> dict[str, str]:
    """Name -> whole log."""
    return {k: (RELOCATED if k == "KernelObjectFieldAccessMismatch" else "") + HEAD + v + "\nprocessed 9 insns (limit 1000000)\n" for k, v in LOGS.items()}


#: Proof events besides the rejection itself, of logs that have any: (established, lost).
EVENTS = {
    "NullScalarDereferenceAfterPointerProof": (0, 1), "NullablePointerUseWithoutProof": (0, 1), "PacketAccessWithoutBoundsProof": (1, 1), "ReturnRangeOutOfBounds": (0, 1), "ScalarRangeUnsafeAtUse": (0, 1), "SharedInstructionPathProofLoss": (0, 1),
    "StalePointerAfterInvalidatingHelper": (0, 1),
}
#: Error ids of logs whose signal leaves the id to the class of the terminal error.
OWN_ERRORS = {
    "E003": ("MapLookupKeyArgumentUnreadable",),
    "E005": ("MapValueWideAccess", "ScalarRangeUnsafeAtUse"),
    "E006": ("Alu32PointerCopyDropsProvenance", "ConstantScalarMemoryLoad", "ModifiedContextPointer", "PointerShiftDropsProvenance", "ProhibitedPointerArithmetic", "SharedInstructionPathProofLoss", "SharedInstructionPointerMerge"),
    "E007": ("WideStackAlignment",),
    "E011": ("ContextAccessSourceArgumentMismatch", "ContextFieldUnavailable"),
}
NAMES = sorted(set(LOGS) & set(N.PREDICATES))


def order_logs(spark, d):
    """(log_id, text): for each order the log that its key chooses, with source files of its own."""
    chosen = F.element_at(F.array(*(F.lit(texts()[n]) for n in NAMES)), (F.col("o_orderkey") % len(NAMES) + 1).cast("int"))
    own = F.regexp_replace(chosen, F.lit(r"@ ([a-z])\.c:"), F.concat(F.lit("@ $1"), F.col("o_orderkey").cast("string"), F.lit(".c:")))
    return P.table(spark, d, "orders").select(F.col("o_orderkey").alias("log_id"), own.alias("text"))


def signal_logs(spark, d):
    """Which signal speaks for each order's log, with its class, error and action, and how many proof events go with it."""
    found = diagnose.explained(logs.lines(order_logs(spark, d)))
    count = lambda role: F.sum(F.size(F.filter("events", lambda e: e["role"] == role))).alias(role)
    return found.groupBy("signal", "failure_class", "error_id", "next_action").agg(F.count("*").alias("n"), F.sum("log_id").alias("sum_ids"), count("established"), count("lost"), count("rejected"))


def _sql() -> str:
    known, own = {row[0]: row for row in N.SIGNALS}, {n: e for e, names in OWN_ERRORS.items() for n in names}
    rows = ", ".join(f"({k}, '{n}', '{known[n][1]}', '{known[n][2]}', '{known[n][6] or own[n]}', {', '.join(map(str, EVENTS.get(n, (0, 0))))})" for k, n in enumerate(NAMES))
    return f"""WITH wanted(k, signal, failure_class, next_action, error_id, established, lost) AS (VALUES {rows})
SELECT signal, failure_class, error_id, next_action, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS sum_ids, CAST(sum(established) AS BIGINT) AS established, CAST(sum(lost) AS BIGINT) AS lost, count(*) AS rejected
FROM orders JOIN wanted ON o_orderkey % {len(NAMES)} = k GROUP BY ALL"""


QUERIES = {"signal_logs": (signal_logs, _sql())}

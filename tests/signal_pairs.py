"""For each signal logs in which it holds and logs, little different, in which it does not."""

from logloom.plans.signal_logs import HEAD

SECTION = "libbpf: sec '{}': found program 'p' at insn offset 0 (0 bytes), code size 9 insns (72 bytes)\nlibbpf: prog 'p': -- BEGIN PROG LOAD LOG --\n"
CALLBACK = """1: R3=fp-16
2: (85) call bpf_dynptr_from_skb#9 ; R0_w=scalar() fp-16=dynptr_skb()
3: R1=fp-16
4: (85) call bpf_dynptr_slice#9 ; R0_w=mem(sz=8)
5: (bf) r6 = r0 ; R6_w=mem(sz=8)
6: R3=fp{given} R6=mem(sz=8)
7: (85) call {loop}#181
from 7 to 20: frame1: R1=scalar() R2=fp[0]{given} R10=fp0 cb
20: frame1: R2=fp[0]{given} R10=fp0 cb
20: (7b) *(u64 *)(r2 +{off}) = r1
21: (95) exit
from 21 to 8: R6=scalar() R10=fp0
{behind}8: (71) r3 = *(u8 *)(r6 +0)
R6 invalid mem access 'scalar'"""


def callback(loop="bpf_loop", given=-16, off=0, behind=""):
    return CALLBACK.format(loop=loop, given=given, off=off, behind=behind)


#: Signal -> logs in which it holds, and logs in which it does not.
PAIRS = {
    "SharedInstructionUninitializedRegister": (
        ["2: R2=scalar() R10=fp0\n2: (bf) r3 = r2\nfrom 1 to 2: R1=ctx() R10=fp0\n2: (bf) r3 = r2\nR2 !read_ok"],
        ["2: R4=scalar() R10=fp0\n2: (bf) r3 = r2\nR2 !read_ok", "; x @ a.c:1\n2: R2=scalar() R10=fp0\n2: (bf) r3 = r2\nR2 !read_ok"],
    ),
    "SubprogramContextArgumentDropped": (
        ["1: R1=ctx() R6=ctx()\n2: (bf) r1 = r7 ; R1_w=scalar()\n; ret = handle(ctx, x); @ a.c:5\n3: (85) call pc+4\narg#0 expects pointer to ctx\nCaller passes invalid args into func#1 ('handle')"],
        ["1: R1=ctx() R6=ctx()\n; ret = handle(ctx, x); @ a.c:5\n3: (85) call pc+4\narg#0 expects pointer to ctx\nCaller passes invalid args into func#1 ('handle')", "1: R1=ctx()\n2: (bf) r1 = r7 ; R1_w=scalar()\n; ret = handle(y, x); @ a.c:5\n3: (85) call pc+4\narg#0 expects pointer to ctx\nCaller passes invalid args into func#1 ('handle')"],
    ),
    "PacketPointerProofLostAfterBoundsCheck": (
        ["1: R2=pkt(r=8)\n; if (data + 14 > data_end) @ x.c:10\n2: (bf) r2 = r3 ; R2_w=scalar()\n; x = *p; @ x.c:12\n3: (71) r4 = *(u8 *)(r2 +0)\nR2 invalid mem access 'scalar'"],
        ["1: R2=pkt(r=8)\n; y = 1; @ x.c:10\n2: (bf) r2 = r3 ; R2_w=scalar()\n; x = *p; @ x.c:12\n3: (71) r4 = *(u8 *)(r2 +0)\nR2 invalid mem access 'scalar'"],
    ),
    "PacketRangeProofLostBeforeAccess": (
        ["; if (data + 14 > data_end) @ x.c:10\n1: (07) r2 += 0 ; R2_w=pkt(id=1,r=14)\n; y = 1; @ x.c:11\n2: (07) r2 += 0 ; R2_w=pkt(id=1,r=0)\n; z = data[10]; @ x.c:12\n3: (61) r3 = *(u32 *)(r2 +10)\ninvalid access to packet, off=10 size=4, R2(id=1,off=10,r=0)\nR2 offset is outside of the packet"],
        ["; if (data + 14 > data_end) @ x.c:10\n1: (07) r2 += 0 ; R2_w=pkt(id=1,r=8)\n; y = 1; @ x.c:11\n2: (07) r2 += 0 ; R2_w=pkt(id=1,r=0)\n; z = data[10]; @ x.c:12\n3: (61) r3 = *(u32 *)(r2 +10)\ninvalid access to packet, off=10 size=4, R2(id=1,off=10,r=0)\nR2 offset is outside of the packet"],
    ),
    "MapValueCheckedOffsetRelationLost": (
        ["; if (pos.idx < 64) @ m.c:10\n1: (25) if r3 > 0x3f goto pc+9 ; R3_w=scalar(umax=63)\n; buf[pos.idx] = 1; @ m.c:12\n2: (0f) r2 += r3 ; R2_w=map_value(ks=4,vs=64,smin=0,smax=255,umin=0,umax=255,var_off=(0x0; 0xff))\n3: (72) *(u8 *)(r2 +0) = 1\ninvalid access to map value, value_size=64 off=255 size=1\nR2 max value is outside of the allowed memory range"],
        ["; if (pos.idx < 63) @ m.c:10\n1: (25) if r3 > 0x3f goto pc+9 ; R3_w=scalar(umax=63)\n; buf[pos.idx] = 1; @ m.c:12\n2: (0f) r2 += r3 ; R2_w=map_value(ks=4,vs=64,smin=0,smax=255,umin=0,umax=255,var_off=(0x0; 0xff))\n3: (72) *(u8 *)(r2 +0) = 1\ninvalid access to map value, value_size=64 off=255 size=1\nR2 max value is outside of the allowed memory range"],
    ),
    "MapValueGuardExceedsValueSize": (
        ["; if (idx < {}) @ m.c:10\n1: (25) if r3 > 0x7f goto pc+9 ; R3_w=scalar(smin=0,smax=127,umin=0,umax=127,var_off=(0x0; 0x7f))\n; v = arr[idx]; @ m.c:12\n2: (0f) r2 += r3 ; R2_w=map_value(ks=4,vs=64,smin=0,smax=127,umin=0,umax=127,var_off=(0x0; 0x7f))\n3: (71) r4 = *(u8 *)(r2 +0)\ninvalid access to map value, value_size=64 off=127 size=1\nR2 max value is outside of the allowed memory range".format(n) for n in (128,)],
        ["; if (idx < {}) @ m.c:10\n1: (25) if r3 > 0x7f goto pc+9 ; R3_w=scalar(smin=0,smax=127,umin=0,umax=127,var_off=(0x0; 0x7f))\n; v = arr[idx]; @ m.c:12\n2: (0f) r2 += r3 ; R2_w=map_value(ks=4,vs=64,smin=0,smax=127,umin=0,umax=127,var_off=(0x0; 0x7f))\n3: (71) r4 = *(u8 *)(r2 +0)\ninvalid access to map value, value_size=64 off=127 size=1\nR2 max value is outside of the allowed memory range".format(n) for n in (32,)],
    ),
    "SubprogramReferenceMetadataMissing": (
        ["; r = handle((void *)p); @ a.c:5\n1: R1=scalar()\n2: (85) call pc+4\narg#0 reference type('UNKNOWN ') size cannot be determined: -22\nCaller passes invalid args into func#1 ('handle')"],
        ["; r = handle(p); @ a.c:5\n1: R1=scalar()\n2: (85) call pc+4\narg#0 reference type('UNKNOWN ') size cannot be determined: -22\nCaller passes invalid args into func#1 ('handle')"],
    ),
    "DynptrReadonlyPacketWrite": (
        ["1: R3=fp-16\n2: (85) call bpf_dynptr_from_skb#9 ; R0_w=scalar() fp-16=dynptr_skb()\n3: R1=fp-16\n4: (85) call bpf_dynptr_slice_rdwr#9\nthe prog does not allow writes to packet data"],
        ["1: R4=fp-16\n2: (85) call bpf_dynptr_from_mem#9 ; R0_w=scalar() fp-16=dynptr_local()\n3: R1=fp-16\n4: (85) call bpf_dynptr_slice_rdwr#9\nthe prog does not allow writes to packet data", "1: R3=fp-32\n2: (85) call bpf_dynptr_from_skb#9 ; R0_w=scalar() fp-32=dynptr_skb()\n3: R1=fp-16\n4: (85) call bpf_dynptr_slice_rdwr#9\nthe prog does not allow writes to packet data"],
    ),
    "DynptrStackSlotWriteOverlap": (
        ["1: R2=fp-16 fp-16=dynptr_ringbuf(ref_id=2) refs=2\n2: (7b) *(u64 *)(r2 +0) = r1\npotential write to dynptr at off=-16 disallowed"],
        ["1: R2=fp-40 fp-16=dynptr_ringbuf(ref_id=2) refs=2\n2: (7b) *(u64 *)(r2 +0) = r1\npotential write to dynptr at off=-40 disallowed"],
    ),
    "DynptrReleaseUnacquiredReference": (
        ["1: R1=fp-16 fp-16=dynptr_ringbuf(ref_id=2)\n2: (85) call bpf_ringbuf_submit_dynptr#199\narg 1 is an unacquired reference"],
        ["1: R1=fp-16 fp-16=dynptr_ringbuf(ref_id=2) refs=2\n2: (85) call bpf_ringbuf_submit_dynptr#199\narg 1 is an unacquired reference", "1: R1=fp-8 fp-16=dynptr_ringbuf(ref_id=2)\n2: (85) call bpf_ringbuf_submit_dynptr#199\narg 1 is an unacquired reference"],
    ),
    "IrqRestoreOrderMismatch": (
        ["1: (85) call bpf_local_irq_save#9 ; R0=1 fp-8=ffffffff refs=2\n2: (85) call bpf_local_irq_save#9 ; R0=1 fp-8=ffffffff fp-16=ffffffff refs=2,3\n3: R1=fp-8 fp-8=ffffffff fp-16=ffffffff refs=2,3\n4: (85) call bpf_local_irq_restore#9\ncannot restore irq state out of order, expected id=3 acquired at insn_idx=2"],
        ["1: (85) call bpf_local_irq_save#9 ; R0=1 fp-8=ffffffff refs=2\n3: R1=fp-8 fp-8=ffffffff refs=2\n4: (85) call bpf_local_irq_restore#9\ncannot restore irq state out of order, expected id=7 acquired at insn_idx=1", "1: (85) call bpf_local_irq_save#9 ; R0=1 fp-8=ffffffff refs=2\n3: R1=fp-8 fp-8=mmmmmmmm refs=2\n4: (85) call bpf_local_irq_restore#9\ncannot restore irq state out of order, expected id=2 acquired at insn_idx=1"],
    ),
    "IrqRestoreHelperClassMismatch": (
        ["1: (85) call bpf_res_spin_lock_irqsave#9 ; R0=0 fp-8=ffffffff refs=2\n2: R1=fp-8 fp-8=ffffffff refs=2\n3: (85) call bpf_local_irq_restore#9\nfunction calls are not allowed while holding a lock"],
        ["1: (85) call bpf_local_irq_save#9 ; R0=0 fp-8=ffffffff refs=2\n2: R1=fp-8 fp-8=ffffffff refs=2\n3: (85) call bpf_local_irq_restore#9\nfunction calls are not allowed while holding a lock"],
    ),
    "PacketContextFieldAccessInUnsupportedProgram": (
        [SECTION.format("tp/skb/kfree_skb") + HEAD + "; d = s->data; @ a.c:2\n1: (61) r6 = *(u32 *)(r1 +76) ; R6_w=scalar()\n; y = *d; @ a.c:3\n2: (71) r3 = *(u8 *)(r6 +0)\nR6 invalid mem access 'scalar'"],
        [SECTION.format("tp/sched/sched_switch") + HEAD + "; d = s->data; @ a.c:2\n1: (61) r6 = *(u32 *)(r1 +76) ; R6_w=scalar()\n; y = *d; @ a.c:3\n2: (71) r3 = *(u8 *)(r6 +0)\nR6 invalid mem access 'scalar'", SECTION.format("tp/skb/kfree_skb") + HEAD + "; d = s->data; @ a.c:2\n1: (61) r6 = *(u32 *)(r1 +72) ; R6_w=scalar()\n; y = *d; @ a.c:3\n2: (71) r3 = *(u8 *)(r6 +0)\nR6 invalid mem access 'scalar'"],
    ),
    "ExceptionCallbackProtocolViolation": (
        ["Validating ex_cb() func#1...\n7: R1=scalar() R10=fp0\n8: (b7) r0 = 7 ; R0_w=7\n9: (95) exit\nAt program exit the register R0 has value 7 should have been in [0, 1]"],
        ["8: (b7) r0 = 7 ; R0_w=7\n9: (95) exit\nAt program exit the register R0 has value 7 should have been in [0, 1]", "Validating ex_cb() func#1...\n8: (b7) r0 = 1 ; R0_w=1\n9: (95) exit\nAt program exit the register R0 has value 1 should have been in [0, 1]"],
    ),
    "LegacySkbLoadUnreadableRegister": (
        ["1: (b7) r2 = 0 ; R2_w=0\n2: (20) r0 = *(u32 *)skb[12]\nR6 !read_ok"],
        ["1: (bf) r6 = r1 ; R6_w=ctx()\n2: (20) r0 = *(u32 *)skb[12]\nR6 !read_ok", "1: (b7) r2 = 0 ; R2_w=0\n2: (61) r0 = *(u32 *)(r6 +12)\nR6 !read_ok"],
    ),
    "HelperStackReadLengthExceedsInitializedRange": (
        ["1: R3=fp-16 R4=16 fp-16=0\n2: (85) call bpf_dynptr_slice#9\ninvalid read from stack R3 off -16+8 size 16\nmemory, len pair leads to invalid memory access", "1: R3=fp-24 R4=24 fp-24=mmmmmmmm fp-16_w=0\n2: (85) call bpf_dynptr_slice#9\ninvalid read from stack R3 off -24+16 size 24\nmemory, len pair leads to invalid memory access"],
        ["1: R3=fp-16 R4=16 fp-16=fp-56\n2: (85) call bpf_dynptr_slice#9\ninvalid read from stack R3 off -16+8 size 16\nmemory, len pair leads to invalid memory access", "1: R3=fp-16 R4=16 fp-16=0 fp-8_rw=0\n2: (85) call bpf_dynptr_slice#9\ninvalid read from stack R3 off -16+8 size 16\nmemory, len pair leads to invalid memory access"],
    ),
    "HelperStackReadExceedsInitializedRange": (
        ["1: R3=fp-16 R4=16 fp-16=0\n2: (85) call bpf_dynptr_slice#9\ninvalid read from stack R3 off -16+4 size 16\nmemory, len pair leads to invalid memory access"],
        ["1: R3=fp-16 R4=16 fp-16_w=0 fp-8=00000000\n2: (85) call bpf_dynptr_slice#9\ninvalid read from stack R3 off -16+4 size 16\nmemory, len pair leads to invalid memory access", "1: R3=fp-16 R4=16 fp-16=258 fp-8=mmmmmmmm\n2: (85) call bpf_dynptr_slice#9\ninvalid read from stack R3 off -16+4 size 16\nmemory, len pair leads to invalid memory access"],
    ),
    "DynptrDataPointerInvalidatedBeforeUse": (
        [callback(), callback(off=8), callback(given=-8)],
        [callback(loop="bpf_for_each_map_elem"), callback(off=16), callback(given=-40), callback(off=40, behind="8: R2=fp-16\n8: (7b) *(u64 *)(r2 +0) = r1\n")],
    ),
    "PacketGuardUndercoversAccess": (
        ["; if (data + 8 > data_end) @ x.c:10\n1: R2=pkt(id=1,r=8) R3=pkt(id=1,off=8,r=8) R4=pkt_end()\n1: (2d) if r3 > r4 goto pc+9 ; R3=pkt(id=1,off=8,r=8) R4=pkt_end()\n; x = data[10]; @ x.c:12\n2: (71) r5 = *(u8 *)(r2 +10)\ninvalid access to packet, off=10 size=1, R2(id=1,off=0,r=8)"],
        ["; if (data + 8 > data_end) @ x.c:10\n1: R2=pkt(id=1,r=8) R3=pkt(id=2,off=8,r=8) R4=pkt_end()\n1: (2d) if r3 > r4 goto pc+9 ; R3=pkt(id=2,off=8,r=8) R4=pkt_end()\n; x = data[10]; @ x.c:12\n2: (71) r5 = *(u8 *)(r2 +10)\ninvalid access to packet, off=10 size=1, R2(id=1,off=0,r=8)"],
    ),
    "PacketMaxOffsetPrecisionBoundary": (
        ["; if (p + 4 > data_end) @ x.c:10\n1: R2=pkt(id=1,off={off},r=0,smin=0,smax={most},umin=0,umax={most},var_off=(0x0; 0xffff)) R3=pkt(id=1,off=8,r=0,smin=0,smax={most},umax={most},var_off=(0x0; 0xffff)) R4=pkt_end()\n1: (2d) if r3 > r4 goto pc+9 ; R3=pkt(id=1,off=8,r=0,umax={most}) R4=pkt_end()\n; x = *p; @ x.c:12\n2: (61) r5 = *(u32 *)(r2 +0)\ninvalid access to packet, off=0 size=4, R2(id=1,off=0,r=0)".format(off=off, most=most) for off, most in ((4, 65535), (-4, 65535))],
        ["; if (p + 4 > data_end) @ x.c:10\n1: R2=pkt(id=1,off=-4,r=0,smin=0,smax=100,umin=0,umax=100,var_off=(0x0; 0x7f)) R3=pkt(id=1,off=8,r=0,umax=100) R4=pkt_end()\n1: (2d) if r3 > r4 goto pc+9 ; R3=pkt(id=1,off=8,r=0,umax=100) R4=pkt_end()\n; x = *p; @ x.c:12\n2: (61) r5 = *(u32 *)(r2 +0)\ninvalid access to packet, off=0 size=4, R2(id=1,off=0,r=0)"],
    ),
    "MapValueRelationPrecisionBoundary": (
        ["; len = MIN(len, sizeof(e->content) - off); @ m.c:8\n1: R1=map_value(off=0,ks=4,vs=64,smin=0,smax=63,umin=0,umax=63,var_off=(0x0; 0x3f)) R2=scalar(smin=0,smax=64,umin=0,umax=64)\n; bpf_probe_read(&event->content[event->len], len, p); if (a > min, b) @ m.c:9\n2: (85) call bpf_probe_read#4\ninvalid access to map value, value_size=64 off=63 size=64\nR1 max value is outside of the allowed memory range"],
        ["; len = 5; @ m.c:8\n1: R1=map_value(off=0,ks=4,vs=64,smin=0,smax=63,umin=0,umax=63,var_off=(0x0; 0x3f)) R2=scalar(smin=0,smax=64,umin=0,umax=64)\n; copy(p); @ m.c:9\n2: (85) call bpf_probe_read#4\ninvalid access to map value, value_size=64 off=63 size=64\nR1 max value is outside of the allowed memory range"],
    ),
}


def whole_logs():
    """Name with sign and number -> log."""
    return {f"{name} {sign}{k}": (log if "libbpf:" in log else HEAD + log) + "\nprocessed 9 insns (limit 1000000)\n" for name, both in PAIRS.items() for sign, of in zip("+-", both, strict=True) for k, log in enumerate(of)}

"""Which proof signals hold at each rejection, and which of them speaks for it.

Most signals are conditions on a context row (`functions.signals`). What they need besides is prepared here, one small DataFrame by
log for each question, from the instructions, states and slots of the fragment: chains of assignments, overlaps of stack slots,
depths of locks, calls between two places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import helpers as H
from ..functions import instructions as I
from ..functions import messages as M
from ..functions import ranges as R
from ..functions import signals as P
from ..functions import sources as T
from ..functions import states as S
from ..functions.binding import apart
from ..functions.lines import ascii_lower
from . import events as E
from . import asof, loader, logs, sites, states
from .storage import kept, side_by_side, together

# Helpers that change a packet so that pointers into it are void.
PACKET_CHANGERS = (
    "bpf_xdp_adjust_head", "bpf_xdp_adjust_meta", "bpf_xdp_adjust_tail", "bpf_skb_store_bytes", "bpf_skb_pull_data", "bpf_skb_change_head", "bpf_skb_change_tail", "bpf_skb_change_proto", "bpf_skb_adjust_room", "bpf_skb_vlan_push",
    "bpf_skb_vlan_pop", "bpf_l3_csum_replace", "bpf_l4_csum_replace", "bpf_lwt_push_encap", "bpf_lwt_seg6_store_bytes", "bpf_lwt_seg6_adjust_srh", "bpf_lwt_seg6_action",
)
IRQ_SAVES = ("bpf_local_irq_save", "bpf_res_spin_lock_irqsave")
# Sources in which a copy is clamped to what is left of a value.
CLAMPED = (" min,", "&event->content[event->len]", "&event->payload[total_len]")


def _true(c: Column) -> Column:
    return F.max(F.coalesce(c, F.lit(False)).cast("int")) == 1


def line_facts(all_lines: DataFrame, ctx: DataFrame) -> DataFrame:
    """By log: alu32_copy, has_subprogram, prior (the three lines above the error, in its fragment), validation (line of an open
    validation at the error), exception_called (the reported call, with a validation behind it)."""
    point = ctx.select("log_id", F.col("line_no").alias("t_line"), "message", "register", "fragment_start", apart(M.natural_after(F.col("message"), "insn ")).alias("call_pc"))
    rows = all_lines.join(point, "log_id").withColumn("trimmed", F.trim("line"))
    line, low = F.col("line"), ascii_lower(F.col("line"))
    reg = F.col("register").cast("string")
    copy = line.contains(F.concat(F.lit("(bc) w"), reg, F.lit(" = w"))) & line.contains(F.concat(F.lit("R"), reg, F.lit("_w=scalar"))) & (line.contains("=pkt(") | line.contains("=ctx("))
    subprogram = F.ltrim(line).startswith("func#1 @") | low.contains("points to subprog") | (low.contains("added ") & low.contains("sub-prog"))
    above = (F.col("line_no") >= F.greatest(F.col("fragment_start"), F.col("t_line") - 3)) & (F.col("line_no") < F.col("t_line"))
    within = (F.col("line_no") >= F.col("fragment_start")) & (F.col("line_no") < F.col("t_line"))
    opens, closes = within & I.opens_validation(F.col("trimmed")), within & I.closes_validation(F.col("trimmed"))
    called = within & F.col("call_pc").isNotNull() & (I.pc(F.col("trimmed")) == F.col("call_pc")) & I.is_instruction(F.col("trimmed"))
    found = rows.groupBy("log_id").agg(
        _true(copy).alias("alu32_copy"), _true(subprogram).alias("has_subprogram"), F.collect_list(F.when(above, line)).alias("_prior"), _true((F.col("line_no") == F.col("t_line")) & line.contains(F.col("message"))).alias("_whole"),
        F.max(F.when(opens, F.col("line_no"))).alias("opened"), F.max(F.when(closes, F.col("line_no"))).alias("closed"), F.max_by(F.struct("line_no", I.call_target(I.tail(F.col("trimmed"))).alias("target")), F.when(called, F.col("line_no"))).alias("_call"), F.max(F.when(called, F.col("line_no"))).alias("_called"),
    )
    active = F.when(F.col("opened") > F.coalesce("closed", F.lit(0)), F.col("opened"))
    thrown = F.col("_called").isNotNull() & F.col("_call.target").isNotNull() & (F.col("opened") >= F.col("_called"))
    return found.select("log_id", "alu32_copy", "has_subprogram", F.when(F.col("_whole"), F.col("_prior")).otherwise(F.array().cast("array<string>")).alias("prior"), active.alias("validation"), F.coalesce(thrown, F.lit(False)).alias("exception_called"))


def entry_facts(ctx: DataFrame, long: DataFrame, facts: DataFrame) -> DataFrame:
    """By log: entry_registers (known at the first state of pc 0 that has the context), validated_r0 (r0 inside an open validation)."""
    point = ctx.select("log_id", "fragment_start", F.col("pc").alias("t_pc"), F.col("line_no").alias("t_line")).join(facts.select("log_id", "validation"), "log_id", "left")
    rows = long.where("plain").select("log_id", "log_line", F.col("pc"), "reg", "state").join(point, "log_id")
    first = rows.where("pc = 0 and log_line >= fragment_start").groupBy("log_id", "log_line").agg(F.collect_set("reg").alias("regs"), _true((F.col("reg") == 1) & (F.col("state.reg_type") == "ctx")).alias("ctx")).where("ctx")
    entry = first.groupBy("log_id").agg(F.min_by("regs", "log_line").alias("entry_registers"))
    inside = rows.where("reg = 0 and log_line >= validation and log_line < t_line and (t_pc is null or pc <= t_pc)")
    return entry.join(inside.groupBy("log_id").agg(F.max_by("state", "log_line").alias("validated_r0")), "log_id", "full")


# ---- chains of assignments ----


def chain_starts(ctx: DataFrame) -> DataFrame:
    """(log_id, reg, frame, before_line, p_from) of the accesses whose register's history is asked for."""
    wanted = ctx.where((F.col("obligation") == "PointerProvenance") & F.col("base").isNotNull() & M.is_scalar_access(F.col("message")))
    return wanted.select("log_id", F.col("base").alias("reg"), F.try_element_at("regs", "base")["before_all"]["frame"].alias("frame"), F.col("call.line").alias("before_line"), F.col("call.fragment").alias("p_from"))


def origins(start: DataFrame, chain: DataFrame, rows: DataFrame, found: DataFrame, long: DataFrame, events: DataFrame) -> DataFrame:
    """By log, of the register that a scalar access uses: origin (line_no, pc, tail of its last assignment, base_kind of what that
    loaded from, source, null_return: its value goes back, by copies, to a helper that returns null at its end), refined_to_zero and
    overwritten_with_zero (why it is zero)."""
    target = I.call_target(F.col("tail"))
    iterates = target.isin("bpf_iter_num_next", "71886", "71889") | (target.startswith("bpf_iter_") & target.endswith("_next"))
    nulls = chain.groupBy("log_id").agg(_true((F.col("reg") == 0) & iterates).alias("null_return"))
    last = chain.where("hop = 0").join(start.select("log_id", "p_from"), "log_id")
    own = last.select("log_id", F.lit("own").alias("point_id"), F.col("line_no").alias("p_line"), F.col("pc").alias("p_pc"), "p_from", "reg", "frame")
    base = last.select("log_id", F.lit("base").alias("point_id"), F.col("line_no").alias("p_line"), F.col("pc").alias("p_pc"), "p_from", I.base_register(F.col("tail")).alias("reg"), "frame").where("reg is not null")
    seen = sites.registers_before(own.unionByName(base), found, long)
    kind = F.col("seen.state.reg_type")
    pointer = (kind.isin("map_value", "mem", "rdonly_mem", "ringbuf_mem", "sock", "tcp_sock") | kind.startswith("ptr_") | kind.startswith("rcu_ptr")) & ~kind.contains("_or_null")
    facts = seen.groupBy("log_id").agg(F.max(F.when(F.col("point_id") == "base", kind)).alias("base_kind"), _true((F.col("point_id") == "own") & pointer & (F.col("seen.frame") == F.col("frame"))).alias("_was_pointer"))
    sourced = sites.sources_at(last.select("log_id", F.col("pc").alias("at_pc")), events)
    zero = F.trim(F.regexp_extract("tail", r" = ([^;]*)", 1)).isin("0", "0x0") & (I.destination(F.col("tail")) == F.col("reg"))
    out = last.join(facts, "log_id", "left").join(nulls, "log_id", "left").join(sourced.withColumnRenamed("at_pc", "pc"), ["log_id", "pc"], "left")
    out = out.select("log_id", F.struct("line_no", "pc", "tail", "base_kind", "source", "null_return").alias("origin"), (zero & F.col("_was_pointer")).alias("overwritten_with_zero"))
    return out.join(refined_to_zero(start, rows, found, long), "log_id", "full")


def refined_to_zero(start: DataFrame, rows: DataFrame, found: DataFrame, long: DataFrame) -> DataFrame:
    """(log_id, refined_to_zero): the register became zero on a branch that compared a nullable pointer with zero, and nothing but zero
    was assigned since."""
    zeros = long.join(start.select("log_id", "reg", F.col("frame").alias("_f"), "before_line", "p_from"), ["log_id", "reg"]).where(R.is_zero(F.col("state")) & (F.col("frame") == F.col("_f")) & (F.col("log_line") >= F.col("p_from")) & (F.col("log_line") < F.col("before_line")))
    text = I.opcode_body(F.col("tail"))
    branches = rows.select("log_id", F.col("line_no").alias("log_line"), F.col("pc").alias("p_pc"), "tail").where(text.contains(" if ") & text.contains(" goto ") & text.contains("0x0"))
    at = zeros.join(branches, ["log_id", "log_line"]).where(F.array_contains(I.mentioned(text), F.col("reg"))).groupBy("log_id", "reg", "_f", "before_line", "p_from").agg(F.max("log_line").alias("p_line"), F.max_by("p_pc", "log_line").alias("p_pc"))
    seen = sites.registers_before(at.withColumn("point_id", F.lit("branch")), found, long).where(F.col("seen.state.reg_type").contains("_or_null") & (F.col("seen.frame") == F.col("_f")))
    zero = F.trim(F.regexp_extract("tail", r" = ([^;]*)", 1)).isin("0", "0x0") & (I.destination(F.col("tail")) == F.col("reg"))
    later = seen.join(rows.select("log_id", "line_no", "tail"), "log_id").where((F.col("line_no") > F.col("p_line")) & (F.col("line_no") < F.col("before_line")) & I.assigns(F.col("tail"), F.col("reg")) & ~F.coalesce(zero, F.lit(False))).select("log_id").distinct()
    return seen.select("log_id").distinct().join(later, "log_id", "left_anti").withColumn("refined_to_zero", F.lit(True))


def opaque_values(start: DataFrame, chain: DataFrame, rows: DataFrame, found: DataFrame, long: DataFrame) -> DataFrame:
    """(log_id, probe_read_value): the register's value was loaded, eight bytes wide, from stack bytes that a probe read wrote last."""
    froms = start.select("log_id", "p_from")
    load = I.is_load(F.col("tail")) & (I.access_width(F.col("tail")) == 8) & (I.destination(F.col("tail")) == F.col("reg"))
    loads = chain.where(load).groupBy("log_id").agg(F.min_by(F.struct("line_no", "pc", "tail"), "hop").alias("l")).join(froms, "log_id")
    points = loads.select("log_id", F.lit("load").alias("point_id"), F.col("l.line_no").alias("p_line"), F.col("l.pc").alias("p_pc"), "p_from", I.base_register(F.col("l.tail")).alias("reg"), F.col("l.tail").alias("tail"))
    fixed = (F.col("seen.state.reg_type") == "fp") & ~R.variable_offset(F.col("seen.state"))
    start_of = F.coalesce("seen.state.off", F.lit(0)) + I.access_offset(F.col("tail"))
    access = kept(sites.registers_before(points, found, long).where(fixed)).select("log_id", F.col("p_line").alias("load_line"), "p_from", start_of.alias("a_start"), (start_of + 8).alias("a_end"), F.col("seen.source_frame").alias("a_frame"))
    # what wrote stack bytes before that: stores, and helpers with an output pair
    t = I.call_target(F.col("tail"))
    pair = H.stack_output_pair(t)
    writers = rows.join(access, "log_id").where("line_no < load_line").select("log_id", "line_no", F.col("pc").alias("p_pc"), "tail", "p_from", "a_start", "a_end", "a_frame", t.alias("target"), F.when(I.is_store(F.col("tail")), I.base_register(F.col("tail"))).otherwise(pair.first).alias("reg"), pair.second.alias("len_reg")).where("reg is not null")
    writers = writers.withColumn("point_id", F.col("line_no").cast("string")).withColumn("p_line", F.col("line_no"))
    at = kept(sites.registers_before(kept(writers), found, long)).where(fixed & (F.col("seen.source_frame") == F.col("a_frame")))
    lengths = sites.registers_before(at.select("log_id", "point_id", "p_line", "p_pc", "p_from", F.col("len_reg").alias("reg")).where("reg is not null"), found, long).select("log_id", "point_id", R.exact_scalar(F.col("seen.state")).cast("long").alias("length"))
    at = at.join(lengths, ["log_id", "point_id"], "left")
    w_start = F.coalesce("seen.state.off", F.lit(0)) + F.when(F.col("target").isNull(), I.access_offset(F.col("tail"))).otherwise(0)
    size = F.when(F.col("target").isNull(), I.access_width(F.col("tail")).cast("long")).otherwise(F.col("length"))
    at = at.withColumn("w_start", w_start).withColumn("w_end", w_start + size).where((F.col("w_start") < F.col("a_end")) & (F.col("a_start") < F.col("w_end")))
    covers = H.probe_read_value_pair(F.col("target")).first.isNotNull() & (F.col("w_start") <= F.col("a_start")) & (F.col("w_end") >= F.col("a_end"))
    return at.groupBy("log_id").agg(F.max_by(covers, "line_no").alias("probe_read_value"))


# ---- packets and dynptrs that calls made void ----


def invalidated_packets(ctx: DataFrame, rows: DataFrame, long: DataFrame) -> DataFrame:
    """(log_id, packet_invalidated): the register held a packet pointer, was not assigned since, and a call changed the packet."""
    point = ctx.where("base is not null").select("log_id", F.col("base").alias("reg"), F.try_element_at("regs", "base")["before_all"]["frame"].alias("_f"), F.col("call.line").alias("s_line"), F.col("call.pc").alias("s_pc"), F.col("call.fragment").alias("p_from"))
    held = long.join(point, ["log_id", "reg"]).where((F.col("state.reg_type") == "pkt") & (F.col("frame") == F.col("_f")) & (F.col("log_line") >= F.col("p_from")) & (F.col("log_line") < F.col("s_line")) & (F.col("pc") <= F.col("s_pc"))).select("log_id", "log_line")
    marks = rows.join(point.select("log_id", "reg", "_f"), "log_id").groupBy("log_id").agg(
        F.max(F.when(I.assigns(F.col("tail"), F.col("reg")) & (F.col("frame").isNull() | (F.col("frame") == F.col("_f"))), F.col("line_no"))).alias("assigned"), F.max(F.when(I.call_target(F.col("tail")).isin(*PACKET_CHANGERS), F.col("line_no"))).alias("changed"))
    met = held.join(marks, "log_id").where("(assigned is null or log_line >= assigned) and log_line < changed")
    return met.select("log_id").distinct().withColumn("packet_invalidated", F.lit(True))


def dynptr_slots(ctx: DataFrame, rows: DataFrame, found: DataFrame, long: DataFrame) -> DataFrame:
    """(log_id, line_no, target, slot (frame, off)): calls on dynptrs of the fragment with the stack slot that they are given."""
    t = I.call_target(F.col("tail"))
    reg = F.coalesce(H.dynptr_output(t), H.dynptr_data_producer(t), H.dynptr_data_invalidating(t))
    calls = rows.select("log_id", "line_no", F.col("pc").alias("p_pc"), t.alias("target"), reg.alias("reg")).where("reg is not null").join(ctx.select("log_id", F.col("call.fragment").alias("p_from")), "log_id")
    own = ctx.where(F.col("c_target") == "bpf_dynptr_slice_rdwr").select("log_id", F.col("call.line").alias("line_no"), F.col("call.pc").alias("p_pc"), F.col("c_target").alias("target"), F.lit(1).alias("reg"), F.col("call.fragment").alias("p_from"))
    points = calls.unionByName(own).withColumn("point_id", F.col("line_no").cast("string")).withColumn("p_line", F.col("line_no"))
    fixed = (F.col("seen.state.reg_type") == "fp") & ~R.variable_offset(F.col("seen.state")) & F.col("seen.state.off").isNotNull()
    return sites.registers_before(points, found, long).where(fixed).select("log_id", "line_no", "target", F.struct(F.col("seen.source_frame").alias("frame"), F.col("seen.state.off").alias("off")).alias("slot"))


def dynptr_facts(ctx: DataFrame, chain: DataFrame, rows: DataFrame, found: DataFrame, long: DataFrame) -> DataFrame:
    """By log: dynptr_backing (of the slot that the call is given), dynptr_invalidated (the register's data came from a dynptr, whose slot
    or packet a later call changed)."""
    slots = kept(dynptr_slots(ctx, rows, found, long))
    made = slots.where(F.col("target").isin(*H.DYNPTR_BACKING)).select("log_id", F.col("line_no").alias("made_line"), "slot", H.dynptr_backing(F.col("target")).alias("backing"))
    given = slots.join(ctx.select("log_id", F.col("call.line").alias("line_no")), ["log_id", "line_no"])
    backing = given.join(made, ["log_id", "slot"]).where("made_line < line_no").groupBy("log_id").agg(F.max_by("backing", "made_line").alias("dynptr_backing"))
    # data pointers: a chain of copies back to r0 of a producer
    produced = chain.where((F.col("reg") == 0) & H.dynptr_data_producer(I.call_target(F.col("tail"))).isNotNull()).select("log_id", "line_no")
    origin = slots.join(produced, ["log_id", "line_no"]).join(made, ["log_id", "slot"]).where("made_line < line_no").groupBy("log_id", "line_no", "slot").agg(F.max_by("backing", "made_line").alias("backing")).withColumnRenamed("line_no", "origin_line")
    changed = slots.where(H.dynptr_data_invalidating(F.col("target")).isNotNull()).select("log_id", F.col("line_no").alias("at"), F.col("slot").alias("changed_slot"), F.lit(None).cast("string").alias("changer"))
    packets = rows.where(I.call_target(F.col("tail")).isin(*PACKET_CHANGERS)).select("log_id", F.col("line_no").alias("at"), F.lit(None).cast(slots.schema["slot"].dataType).alias("changed_slot"), I.call_target(F.col("tail")).alias("changer"))
    origin = kept(origin)
    met = origin.join(changed.unionByName(packets), "log_id").where((F.col("at") > F.col("origin_line")) & (F.col("changed_slot").eqNullSafe(F.col("slot")) | (F.col("changer").isNotNull() & (F.col("backing") == "packet"))))
    void = met.select("log_id").union(callback_writes(origin, ctx, rows, found, long)).distinct()
    return backing.join(void.withColumn("dynptr_invalidated", F.lit(True)), "log_id", "full")


def _fixed_slot(state: Column) -> Column:
    """Whether a state is a pointer to one place in a frame."""
    return (state["reg_type"] == "fp") & ~R.variable_offset(state) & state["off"].isNotNull()


def callback_writes(origin: DataFrame, ctx: DataFrame, rows: DataFrame, found: DataFrame, long: DataFrame) -> DataFrame:
    """(log_id): data of a dynptr that a callback of a loop wrote over before the site.

    origin: (log_id, origin_line, slot). The loop's call hands its callback a pointer to the dynptr (r3 there, r2 inside), and a store of
    that activation, by the latest whole state before it, overlaps the dynptr's 16 bytes. Activations are told by the state that enters
    them: whole states and registers come from the ordered look-ups, so neither entries nor stores meet all states of a log."""
    point = ctx.select("log_id", F.col("call.line").alias("s_line"), F.col("call.fragment").alias("p_from")).join(origin.select("log_id", "origin_line", "slot"), "log_id")
    entered = long.where("from_pc is not null and reg = 2").where(S.callback(F.col("tokens")) == "sync").select("log_id", "log_line", "frame", "from_pc", F.col("state").alias("r2"))
    entered = entered.join(point, "log_id").where("log_line > origin_line and log_line < s_line").where(_fixed_slot(F.col("r2")))
    entered = entered.select("log_id", F.col("log_line").alias("entry"), F.col("frame").alias("entry_frame"), F.col("from_pc").alias("pc"), "s_line", "p_from", "slot", F.struct(F.coalesce("r2.source_frame", "frame").alias("frame"), F.col("r2.off").alias("off")).alias("given"))
    reaches = (F.col("given.frame") == F.col("slot.frame")) & (F.col("given.off") >= F.col("slot.off")) & (F.col("given.off") < F.col("slot.off") + 16)
    entered = kept(entered.where(reaches))
    if entered.isEmpty():  # few programs hand a dynptr to a loop: the rest is planned only for those
        return entered.select("log_id")
    calls = asof.latest(entered.withColumn("line_no", F.col("entry")), rows.select("log_id", "pc", "line_no", "tail"), ["log_id", "pc"], "line_no", F.struct("line_no", "tail"), name="from_call")
    calls = calls.where((F.col("from_call.line_no") >= F.col("p_from")) & (I.call_target(F.col("from_call.tail")) == "bpf_loop"))
    points = calls.select("*", F.col("entry").cast("string").alias("point_id"), F.col("from_call.line_no").alias("p_line"), F.col("pc").alias("p_pc"), F.lit(3).alias("reg"))
    handed = sites.registers_before(points, found, long).where(_fixed_slot(F.col("seen.state")) & (F.col("seen.source_frame") == F.col("given.frame")) & (F.col("seen.state.off") == F.col("given.off")))
    # the first activation in a frame covers all later ones there
    entries = kept(handed.groupBy("log_id", "entry_frame", "slot", "p_from", "s_line").agg(F.min("entry").alias("entry")))
    stores = rows.where(I.is_store(F.col("tail"))).join(entries.groupBy("log_id", "p_from", "s_line").agg(F.min("entry").alias("_from")), "log_id").where("line_no > _from and line_no < s_line")
    stores = stores.select("log_id", F.col("line_no").cast("string").alias("point_id"), F.col("line_no").alias("p_line"), F.col("pc").alias("p_pc"), "p_from", I.base_register(F.col("tail")).alias("reg"), I.access_offset(F.col("tail")).alias("_off"), I.access_width(F.col("tail")).alias("_width"))
    whole = found.select("log_id", F.col("log_line").alias("at"), F.col("frame").alias("at_frame"), S.callback(F.col("tokens")).alias("at_callback"))
    at = asof.latest_line_below(stores.select("log_id", "point_id", F.col("p_line").alias("log_line"), F.col("p_pc").alias("pc")), found.select("log_id", "log_line", "pc"), ["log_id"], ["log_id", "point_id"], name="at")
    placed = at.select("log_id", "point_id", "at").join(whole, ["log_id", "at"]).where("at_callback = 'sync'")
    seen = sites.registers_before(stores, found, long).where((F.col("seen.state.reg_type") == "fp") & ~R.variable_offset(F.col("seen.state"))).join(placed, ["log_id", "point_id"])
    start = F.coalesce("seen.state.off", F.lit(0)) + F.col("_off")
    met = seen.withColumn("w_start", start).withColumn("w_end", start + F.col("_width")).join(entries.select("log_id", "entry_frame", "slot", "entry"), "log_id")
    inside = (F.col("at") >= F.col("entry")) & (F.col("at_frame") == F.col("entry_frame"))
    over = (F.col("seen.source_frame") == F.col("slot.frame")) & (F.col("w_start") < F.col("slot.off") + 16) & (F.col("slot.off") < F.col("w_end"))
    return met.where(inside & over).select("log_id").distinct()


# ---- stack slots ----


def overlaps(ctx: DataFrame, slots: DataFrame) -> DataFrame:
    """(log_id, overlaps): by name of the access, what its bytes met in the newest state (`sites.slot_overlaps`)."""
    m = F.col("message")
    read = M.stack_read(m)
    of = lambda n, look_up: F.try_element_at("regs", n)[look_up]
    base = of(F.col("base"), "before")
    base_frame = F.when(base["state"]["reg_type"] == "fp", base["source_frame"])
    named = of(read["register"], "before")
    frame = F.coalesce(F.when(named["state"]["reg_type"] == "fp", named["source_frame"]), base_frame, F.col("state_before.frame"), F.lit(0))
    at = F.coalesce(base["state"]["off"], F.lit(0)).cast("long") + F.col("off")
    has_base = base_frame.isNotNull() & F.col("width").isNotNull()
    start, end = F.when(read.isNotNull(), read["start"]).when(I.is_load(F.col("tail")) & has_base, at), F.when(read.isNotNull(), read["end"]).when(I.is_load(F.col("tail")) & has_base, at + F.col("width"))
    written = M.signed_after(m, "off=")

    def access(name, lo, hi, frame_, kind, size, by_error=True, when=None):
        bounds = (F.col("fragment_start"), F.col("pc"), F.col("line_no")) if by_error else (F.col("call.fragment"), F.col("call.pc"), F.col("call.line"))
        row = F.struct(F.lit(name).alias("access_id"), lo.cast("long").alias("a_start"), hi.cast("long").alias("a_end"), frame_.cast("int").alias("a_frame"), bounds[0].cast("long").alias("a_from"), bounds[1].cast("long").alias("a_pc"), bounds[2].cast("long").alias("a_line"), F.lit(kind).alias("a_type"), F.lit(size).alias("a_size"))
        return F.when(F.coalesce(F.lit(True) if when is None else when, F.lit(False)), row)

    def argument(name, reg, kind, size, wide, by_error=False):
        a = of(reg, "argument")
        fixed = (a["state"]["reg_type"] == "fp") & a["state"]["off"].isNotNull()
        if kind == "dynptr":
            fixed = fixed & ~R.variable_offset(a["state"])
        return access(name, a["state"]["off"], a["state"]["off"] + wide, a["source_frame"], kind, size, by_error, fixed)

    t = F.col("c_target")
    flag = F.when(t == "bpf_res_spin_unlock_irqrestore", 2).otherwise(1)
    rows = F.array(
        access("dynptr_read", start, end, frame, "dynptr", 16, when=start.isNotNull()), access("iter_read", start, end, frame, "iter_", 8, when=start.isNotNull()),
        access("dynptr_write", written, written + 1, F.coalesce(base_frame, F.col("state_before.frame"), F.lit(0)), "dynptr", 16, when=written.isNotNull() & F.col("site").isNotNull()),
        access("plain_write", at, at + F.col("width"), base_frame, "dynptr", 16, False, I.is_store(F.col("tail")) & has_base),
        argument("dynptr_initialized", H.dynptr_initialized(t), "dynptr", 16, 16), argument("dynptr_output", H.dynptr_output(t), "dynptr", 16, 16), argument("dynptr_live", H.dynptr_live(t), "dynptr", 16, 16),
        argument("iter_new", F.lit(1), "iter_", 8, 8, True), argument("iter_argument", F.lit(1), "iter_", 8, 8), argument("irq", flag, "irq", 8, 1, True),
    )
    accesses = ctx.select("log_id", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("a")).select("log_id", "a.*").where("a_start < a_end")
    met = sites.slot_overlaps(accesses, slots)
    return met.groupBy("log_id").agg(F.map_from_entries(F.collect_list(F.struct("access_id", F.struct(*(c for c in met.columns if c not in ("log_id", "access_id")))))).alias("overlaps"))


# ---- calls before the site ----


def call_facts(ctx: DataFrame, rows: DataFrame, found: DataFrame) -> DataFrame:
    """By log: acquired_target (of the interrupt state that the message names), reference_acquired (the call that the message names hands
    out the reference, which a state holds before the exit), irq_save_refs (references of states at saving calls), callback_origin
    (the call from which the callback of the site was entered), argument_rewritten (the argument's register was written since)."""
    low = ascii_lower(F.col("message"))
    point = ctx.select("log_id", M.natural_after(low, "acquired at insn_idx=").alias("acquired_pc"), M.natural_after(low, "alloc_insn=").alias("alloc_pc"), M.natural_after(low, "reference id=").alias("ref_id"), F.col("callback_entry.from_pc").alias("from_pc"), F.col("callback_entry.log_line").alias("entered"), "register", F.try_element_at("regs", "register")["argument"]["log_line"].alias("known_line"), F.col("call.line").alias("s_line"))
    met = rows.join(point, "log_id").withColumn("target", I.call_target(F.col("tail")))
    last = lambda cond: F.max_by(F.struct("line_no", "target"), F.when(cond, F.col("line_no")))
    seen = met.groupBy("log_id").agg(
        last(F.col("pc") == F.col("acquired_pc")).alias("acquired"), F.max((F.col("pc") == F.col("acquired_pc")).cast("int")).alias("_a"), last(F.col("pc") == F.col("alloc_pc")).alias("alloc"), F.max((F.col("pc") == F.col("alloc_pc")).cast("int")).alias("_l"),
        last((F.col("pc") == F.col("from_pc")) & (F.col("line_no") < F.col("entered"))).alias("entry"), F.max(((F.col("pc") == F.col("from_pc")) & (F.col("line_no") < F.col("entered"))).cast("int")).alias("_e"),
        _true((F.col("line_no") > F.col("known_line")) & I.writes(F.col("tail"), F.col("register"))).alias("argument_rewritten"), F.first("ref_id").alias("ref_id"), F.first("s_line").alias("s_line"),
    )
    refs = found.where("kind <> 'branch_delta'").select("log_id", "log_line", S.references(F.col("tokens")).alias("ref_ids")).where("size(ref_ids) > 0")
    held = refs.join(seen.select("log_id", "ref_id", "s_line", F.when(F.col("_l") == 1, F.col("alloc")).alias("alloc")), "log_id").where((F.col("log_line") >= F.col("alloc.line_no")) & (F.col("log_line") < F.col("s_line")) & F.array_contains("ref_ids", F.col("ref_id")) & P.acquires_reference(F.col("alloc.target")))
    saved = refs.join(met.where(F.col("target").isin(*IRQ_SAVES)).select("log_id", F.col("line_no").alias("log_line")), ["log_id", "log_line"]).groupBy("log_id").agg(F.array_distinct(F.flatten(F.collect_list("ref_ids"))).alias("irq_save_refs"))
    out = seen.select("log_id", F.when(F.col("_a") == 1, F.col("acquired.target")).alias("acquired_target"), F.when(F.col("_e") == 1, F.col("entry.target")).alias("callback_origin"), F.when(F.col("_e") == 1, F.col("entry.line_no")).alias("callback_line"), "argument_rewritten")
    return out.join(held.select("log_id").distinct().withColumn("reference_acquired", F.lit(True)), "log_id", "left").join(saved, "log_id", "left")


def irq_origins(ctx: DataFrame, rows: DataFrame, found: DataFrame, slots: DataFrame) -> DataFrame:
    """(log_id, irq_origin): the saving call that made the newest live reference, if the flag's slot belongs to it."""
    flag = F.when(F.col("c_target") == "bpf_res_spin_unlock_irqrestore", 2).otherwise(1)
    arg = F.try_element_at("regs", flag)["argument"]
    point = ctx.where(F.col("c_target").isin("bpf_local_irq_restore", "bpf_res_spin_unlock_irqrestore")).select("log_id", F.try_element_at("state_before.ref_ids", F.lit(-1)).alias("newest"), arg["state"]["off"].alias("off"), arg["source_frame"].alias("_f"), F.col("call.line").alias("s_line"), F.col("call.fragment").alias("p_from")).where("newest is not null and off is not null")
    saves = rows.where(I.call_target(F.col("tail")).isin(*IRQ_SAVES)).select("log_id", F.col("line_no").alias("log_line"), I.call_target(F.col("tail")).alias("target"))
    plain = found.where("kind <> 'branch_delta'")
    made = plain.select("log_id", "log_line", S.references(F.col("tokens")).alias("ref_ids")).join(saves, ["log_id", "log_line"]).join(point, "log_id").where(F.array_contains("ref_ids", F.col("newest")) & (F.col("log_line") >= F.col("p_from")) & (F.col("log_line") < F.col("s_line")))
    slots = slots.select("log_id", F.col("log_line").alias("at"), "frame", "slot_off", F.col("ref_ids").alias("held"), (F.col("slot").isNull() & (F.col("slot_types") == "ffffffff")).alias("live"))
    met = made.join(slots, "log_id").where((F.col("frame") == F.col("_f")) & (F.col("slot_off") == F.col("off")) & (F.col("at") < F.col("s_line")))
    seen = met.groupBy("log_id", "log_line", "target").agg(_true((F.col("at") == F.col("log_line")) & F.col("live")).alias("own"), F.max_by("live", F.when(F.col("at") < F.col("log_line"), F.col("at"))).alias("was"), _true(F.col("at") < F.col("log_line")).alias("known"), _true((F.col("at") > F.col("log_line")) & F.col("live") & F.array_contains("held", F.col("newest"))).alias("later"))
    return seen.where(F.col("own") | (F.col("later") & ~(F.col("known") & F.coalesce("was", F.lit(False))))).groupBy("log_id").agg(F.max_by("target", "log_line").alias("irq_origin"))


# ---- sources ----


def guard_facts(all_lines: DataFrame, ctx: DataFrame, long: DataFrame, events: DataFrame) -> DataFrame:
    """By log: guard_covers and lost_guard_covers (a data_end check's branch compares a pointer of the same packet, no less far, with the
    end: that of the quoted check, and that at the pc of the register's last state), guard_linked (a quoted line joins the names of
    guard and rejected line), guard_added (the guarded scalar is the one that was added to the map's pointer)."""
    current = F.try_element_at("regs", "register")["last"]["state"]
    point = ctx.select("log_id", F.col("packet_check.pc").alias("check_pc"), F.col("packet.current.pc").alias("lost_pc"), current.alias("current"))
    ops = E.branch_packet_operands(all_lines, long).join(point, "log_id")
    covers = (F.col("guard.id").eqNullSafe(F.col("current.id"))) & (F.col("current.reg_type") == "pkt") & (F.coalesce("guard.off", F.lit(0)) >= F.coalesce("current.off", F.lit(0)))
    near = lambda pc: F.col("branch_pc").between(F.col(pc), F.col(pc) + 6)
    packets = ops.groupBy("log_id").agg(_true(covers & near("check_pc")).alias("guard_covers"), _true(covers & near("lost_pc")).alias("lost_guard_covers"))
    guards = ctx.where("scalar_guard is not null").select("log_id", F.col("scalar_guard.source").alias("g"), F.col("scalar_guard.pc").alias("guard_pc"), "rejected", "register", current.alias("current"), F.col("pc").alias("t_pc"), F.col("line_no").alias("t_line"))
    both = events.join(guards, "log_id")
    ids = T.identifiers(F.col("source.text"))
    links = (F.col("source.path") == F.col("g.path")) & (F.col("source.line") > F.col("g.line")) & (F.col("source.line") < F.col("rejected.line")) & (F.col("source.text").startswith("for ") | F.col("source.text").startswith("if "))
    links = links & F.arrays_overlap(ids, T.identifiers(F.col("g.text"))) & F.arrays_overlap(ids, T.identifiers(F.col("rejected.text")))
    linked = both.groupBy("log_id").agg(_true(links).alias("guard_linked"))
    quoted = both.where((F.col("source") == F.col("g")) & F.col("pc").eqNullSafe(F.col("guard_pc")) & (F.col("line_no") < F.col("t_line"))).groupBy("log_id").agg(F.max("line_no").alias("guard_line"))
    instr = logs.instructions(all_lines.withColumn("line", F.trim("line")))
    spot = guards.join(quoted, "log_id").select("log_id", "guard_pc", "guard_line", "register", "current", "t_pc", "t_line")
    branches = long.select("log_id", "log_line", "pc", "reg", "state").join(spot, "log_id").where((F.col("pc").between(F.col("guard_pc"), F.col("guard_pc") + 3)) & (F.col("log_line") > F.col("guard_line")) & (F.col("log_line") < F.col("t_line")) & (F.col("state.reg_type") == "scalar") & R.same(F.col("state"), F.col("current")))
    branches = branches.select("log_id", F.col("log_line").alias("line_no"), F.col("pc"), F.col("reg").alias("scalar_reg")).join(instr, ["log_id", "line_no", "pc"]).where(F.array_contains(I.branch_registers(F.col("tail")), F.col("scalar_reg"))).select("log_id", "scalar_reg")
    added = instr.join(spot, "log_id").where((F.col("line_no") > F.col("guard_line")) & (F.col("line_no") < F.col("t_line")) & (F.col("pc") > F.col("guard_pc")) & (F.col("pc") < F.col("t_pc"))).join(branches, "log_id").where(I.adds(F.col("tail"), F.col("register"), F.col("scalar_reg")))
    return packets.join(linked, "log_id", "full").join(added.select("log_id").distinct().withColumn("guard_added", F.lit(True)), "log_id", "full")


def relation_facts(ctx: DataFrame, long: DataFrame, events: DataFrame) -> DataFrame:
    """(log_id, relation_source): the source bounds a copy by what is left of a map's value, in one of three forms."""
    pair = H.map_value_access_pair(F.col("direct"))
    s = F.try_element_at("regs", pair.first)["before_all"]["state"]
    point = ctx.where("access is not null and direct is not null").select("log_id", pair.second.alias("len_reg"), R.remaining(F.col("access.value_size"), s["off"]).alias("room"), F.col("call.pc").alias("s_pc"), F.col("call.line").alias("s_line"), F.col("call.fragment").alias("p_from"), F.transform("events", lambda e: ascii_lower(e["source"]["text"])).alias("texts"))
    near = long.join(point.where("len_reg is not null"), "log_id").where((F.col("reg") == F.col("len_reg")) & (F.col("log_line") >= F.col("p_from")) & (F.col("log_line") < F.col("s_line")) & F.col("pc").between(F.col("s_pc") - 12, F.col("s_pc")) & R.at_most(F.col("state"), F.col("room")))
    bounded = near.select("log_id").distinct().withColumn("bounded", F.lit(True))
    rows = events.join(point, "log_id").join(bounded, "log_id", "left").withColumn("bounded", F.coalesce("bounded", F.lit(False)))
    text = F.col("source.text")
    compares = lambda *ops: reduce(lambda a, b: a | b, (text.contains(o) for o in ops))
    guard = text.contains("if (") & text.contains("+") & compares(" < ", " <= ") & (F.col("bounded") | (T.largest_number(text) <= F.col("room")))
    split = lambda name: _true(text.contains("if (") & text.contains(name) & compares(" <", " <=", " >", " >="))
    found = rows.groupBy("log_id").agg(
        _true(text.contains("bpf_probe_read")).alias("reads"), _true(F.exists("texts", lambda x: reduce(lambda a, b: a | b, (x.contains(c) for c in CLAMPED)))).alias("shape"), _true((text.contains("MIN(") | text.contains("min =")) & F.col("bounded")).alias("clamp"),
        _true(guard).alias("guard"), (split("total_len") & split("to_read") & F.first("bounded")).alias("split"),
    )
    return found.select("log_id", (F.col("reads") & F.col("shape") & (F.col("clamp") | F.col("guard") | F.col("split"))).alias("relation_source"))


def map_facts(ctx: DataFrame, events: DataFrame) -> DataFrame:
    """(log_id, declared_maps_hold): the map that a look-up is given by address is declared above in the same file."""
    name = T.addressed_name(T.call_argument(F.col("rejected.text"), "bpf_map_lookup_elem", 0))
    point = ctx.select("log_id", name.alias("map_name"), "rejected").where("map_name is not null")
    rows = events.join(point, "log_id").where((F.col("source.path") == F.col("rejected.path")) & (F.col("source.line") <= F.col("rejected.line")) & T.declares_map(F.col("source.text"), F.col("map_name")))
    return rows.select("log_id").distinct().withColumn("declared_maps_hold", F.lit(True))


def loader_facts(full_lines: DataFrame, ctx: DataFrame) -> DataFrame:
    """By log: section (of the program being loaded) and relocated_struct (of the field that the message names)."""
    last = full_lines.join(ctx.select("log_id", "message"), "log_id").where(F.col("line").contains(F.col("message"))).groupBy("log_id").agg(F.max("line_no").alias("before_line"))
    scopes = loader.program_scopes(full_lines, last)
    fields = ctx.select("log_id", F.col("site.pc").alias("pc"), F.coalesce(M.natural_after(F.col("message"), "off "), M.natural_after(F.col("message"), "off=")).alias("offset")).where("pc is not null and offset is not null")
    return loader.program_sections(full_lines, scopes).select("log_id", "section").join(loader.relocated_structs(full_lines, scopes, fields), "log_id", "left")


# ---- the whole ----


def prepared(all_lines: DataFrame, classified: DataFrame, full_lines: DataFrame | None = None) -> DataFrame:
    """Contexts with proof events and everything that the signals ask for, as a table."""
    spark, t, tail = all_lines.sparkSession, sites.Tables(all_lines, classified), F.col("site.tail")

    def of_packets():
        packets = kept(E.packet_ranges(t.at, t.registers))
        return packets, kept(E.guarded_ranges(all_lines, t.at, t.registers, t.events, packets))

    ctx, (packets, guards) = together(spark, lambda: sites.contexts(t), of_packets)
    ctx = ctx.withColumn("low", ascii_lower(F.col("message"))).withColumn("tail", tail).withColumn("base", I.base_register(tail)).withColumn("off", I.access_offset(tail)).withColumn("width", I.access_width(tail))
    ctx = ctx.withColumn("target", I.call_target(tail)).withColumn("direct", I.direct_call_target(tail)).withColumn("c_target", I.call_target(F.col("call.tail"))).withColumn("access", M.map_value_access(F.col("message")))
    callee, source = M.called_function(F.col("message")), F.col("site_source.text")
    argument = lambda n: F.when(source.contains(callee), _call_argument(source, callee, n))
    ctx = ctx.withColumn("first_argument", argument(F.lit(0))).withColumn("call_argument", argument(M.zero_based_argument(F.col("message"), "arg#")))
    ctx = ctx.withColumn("initialized", sites.initialized_bytes(F.col("slots"), F.try_element_at("regs", F.coalesce(H.stack_read_pair(F.col("target")).first, F.lit(-1)))["path"]["state"]["off"]))
    packet = packets.select("log_id", F.struct("current", "proven", "required").alias("packet"))
    ctx = kept(E.proof_events(ctx.join(side_by_side([packet, guards], "log_id"), "log_id", "left"), t.events))
    known = (t.instructions, t.found, t.registers)

    def of_lines():
        facts = kept(line_facts(all_lines, ctx))
        return [facts, kept(entry_facts(ctx, t.registers, facts))]

    def of_calls():
        calls = kept(call_facts(ctx, t.instructions, t.found))
        entered = t.at.join(calls.select("log_id", "callback_line"), "log_id").where("callback_line is not null").withColumn("call", F.col("call").withField("line", F.col("callback_line")))
        return [calls, kept(sites.depth_before(all_lines, entered, ("bpf_spin_lock",), ("bpf_spin_unlock",), "callback_lock_depth"))]

    def of_chains():
        start = kept(chain_starts(ctx))
        chain = sites.traced_back(t.instructions, start.drop("p_from"))
        return together(spark, lambda: kept(origins(start, chain, *known, t.events)), lambda: kept(opaque_values(start, chain, *known)), lambda: kept(dynptr_facts(ctx, chain, *known)))

    single = (
        lambda: guard_facts(all_lines, ctx, t.registers, t.events), lambda: overlaps(ctx, t.slots), lambda: irq_origins(ctx, t.instructions, t.found, t.slots), lambda: invalidated_packets(ctx, t.instructions, t.registers),
        lambda: loader_facts(full_lines if full_lines is not None else all_lines, ctx), lambda: relation_facts(ctx, t.registers, t.events), lambda: map_facts(ctx, t.events),
        lambda: states.loop_snapshots(all_lines, t.at).select("log_id", S.same_loop_state(F.col("current"), F.col("previous")).alias("loop_repeats")),
        lambda: sites.depth_before(all_lines, t.at, ("bpf_local_irq_save", "bpf_rcu_read_lock"), ("bpf_local_irq_restore", "bpf_rcu_read_unlock"), "irq_depth"),
    )
    found = together(spark, of_chains, of_lines, of_calls, *(lambda s=s: [kept(s())] for s in single))
    return kept(ctx.join(side_by_side([part for parts in found for part in parts], "log_id"), "log_id", "left"))


def _call_argument(text: Column, function: Column, index: Column) -> Column:
    """As `sources.call_argument`, of a function and place that are columns. Brackets are followed two deep."""
    after = F.substring(text, F.instr(text, function) + F.length(function), F.lit(1 << 20))
    inner = r"(?:[^(),]|\((?:[^()]|\([^()]*\))*\))*"
    inside = F.regexp_extract(after, rf"^\(({inner}(?:,{inner})*)\)?", 1)
    parts = F.regexp_extract_all(F.concat(inside, F.lit(",")), F.lit(rf"({inner}),"), F.lit(1))
    return F.when(after.startswith("("), F.trim(F.get(parts, index)))


#: Signals that are asked in one pass over the contexts: plans with all of them are slow to compile.
AT_ONCE = 10


def hits(ctx: DataFrame) -> DataFrame:
    """Adds signals: those that hold for each log, in the order in which they are asked. Of the fallbacks only the first that holds, and
    only where nothing else does. `ctx` is a table (`prepared`)."""
    names = (*P.ORDER, *P.FALLBACKS)

    def held(some: tuple) -> DataFrame:
        asked = [F.when(F.coalesce(P.PREDICATES[n](), F.lit(False)) & ~F.col("malformed"), F.lit(n)) for n in some]
        return kept(ctx.select("log_id", F.filter(F.array(*asked), lambda x: x.isNotNull()).alias("held"))).where("size(held) > 0")

    found = reduce(DataFrame.unionByName, together(ctx.sparkSession, *(lambda k=k: held(names[k : k + AT_ONCE]) for k in range(0, len(names), AT_ONCE))))
    place = {n: k for k, n in enumerate(names)}
    rows = found.select("log_id", F.explode("held").alias("signal")).withColumn("place", F.create_map(*(F.lit(x) for p in place.items() for x in p))[F.col("signal")])
    signals = F.transform(F.array_sort(F.collect_list(F.struct("place", "signal"))), lambda x: x["signal"])
    by_log = rows.groupBy("log_id").agg(signals.alias("_all"))
    usual = F.filter("_all", lambda x: ~x.isin(*P.FALLBACKS))
    out = ctx.join(by_log, "log_id", "left")
    return out.withColumn("signals", F.when(F.size(usual) > 0, usual).otherwise(F.slice(F.coalesce("_all", F.array().cast("array<string>")), 1, 1))).drop("_all")


def chosen(ctx: DataFrame) -> DataFrame:
    """Adds the signal that speaks for each log: of those that may override its class, the one of the lowest rank, then the first asked."""
    dim = F.broadcast(P.dimension(ctx.sparkSession))
    rows = ctx.select("log_id", "failure_class", F.explode("signals").alias("signal")).join(dim, "signal").where(P.can_override(F.col("signal"), F.col("failure_class"), F.col("replaces_unsupported")))
    w = Window.partitionBy("log_id").orderBy("rank", "place")
    best = rows.withColumn("n", F.row_number().over(w)).where("n = 1").select("log_id", "signal", "signal_class", "signal_action", "rank", "replaces_help", "replaces_unsupported", "signal_error_id")
    return ctx.join(best, "log_id", "left")

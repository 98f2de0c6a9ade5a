"""Where a log was rejected, and what was known there: the instruction of the terminal error, and for each register, slot and
reference the latest state that the instruction could see.

Everything is looked up for one point of each log, so a look-up is a filter and a single ordered aggregate (max_by) over the
log's states; points and states meet on log_id once, and the aggregates by register use the same partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import instructions as I
from ..functions import lines as L
from ..functions import messages as M
from ..functions import ranges as R
from ..functions import sources as T
from ..functions import states as S
from . import states
from .storage import kept, side_by_side, together

FULL = ("edge_full", "pc_full")
# Error lines that are details of a call's error, by what they and the next line contain.
SLOT_DETAILS = ("cannot pass in dynptr at an offset", "dynptr has to be at a constant offset", "expected pointer to stack or const struct bpf_dynptr")
SLOT_ERRORS = ("expected an initialized dynptr", "dynptr has to be an uninitialized dynptr")


def ends_call_search(line: Column, following: Column, error: Column | None = None) -> Column:
    """Where the search upwards for a call stops: at marks and at errors that are not details of the error below."""
    marks = line.startswith("func#") | line.contains(L.BEGIN_MARK) | line.contains(L.END_MARK) | reduce(lambda a, b: a | b, (line.startswith(s) for s in ("processed ", "verification time ", "stack depth ")))
    slot = M.has_any(line, *SLOT_DETAILS) & F.coalesce(M.has_any(following, *SLOT_ERRORS), F.lit(False))
    length = M.has(line, "unbounded memory access", "var") & F.coalesce(M.has(following, "memory, len pair leads to invalid memory access"), F.lit(False))
    return marks | ((L.is_error(line) if error is None else error) & ~slot & ~length)


def sites(all_lines: DataFrame, ends: DataFrame) -> DataFrame:
    """Adds to terminals (log_id, line_no, pc, call_target, ...) fragment_start, the site (last instruction of that pc in the
    fragment) and the call (the site, or the nearest call above that fits): each (line, pc, tail, fragment), null if there is none.
    Look-ups are made for the call, which is the site wherever there is one."""
    w = Window.partitionBy("log_id").orderBy("line_no")
    rows = all_lines.withColumn("line", F.trim("line")).withColumn("following", F.lead("line").over(w))
    # the error's last line counts as its place in the search for a call
    point = ends.select("log_id", F.col("line_no").alias("t_line"), F.col("pc").alias("t_pc"), F.col("call_target").alias("t_call"))
    rows = rows.join(point, "log_id").where("line_no < t_line")
    rows = rows.select("log_id", "line_no", "t_pc", "t_call", "line", "following", L.is_error(F.col("line")).alias("error"), I.pc(F.col("line")).alias("pc"), I.tail(F.col("line")).alias("tail"))
    above = Window.partitionBy("log_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("fragment", F.coalesce(F.last(F.when(L.is_boundary(F.col("line"), F.col("error")), F.col("line_no") + 1), ignorenulls=True).over(above), F.lit(1)))
    here = F.struct(F.col("line_no").alias("line"), "pc", "tail", "fragment")
    fits = F.col("t_call").isNull() | (F.col("t_call") == I.call_target(F.col("tail")))
    last = lambda value, cond: F.max_by(value, F.when(cond, F.col("line_no")))
    called = I.call_target(F.col("tail")).isNotNull() & fits
    found = rows.groupBy("log_id").agg(
        F.coalesce(F.max(F.when(L.is_boundary(F.col("line"), F.col("error")), F.col("line_no") + 1)), F.lit(1)).alias("fragment_start"),
        F.max(F.when(ends_call_search(F.col("line"), F.col("following"), F.col("error")), F.col("line_no"))).alias("edge"),
        F.when(F.max((F.col("pc") == F.col("t_pc")).cast("int")) == 1, last(here, F.col("pc") == F.col("t_pc"))).alias("site"),
        F.when(F.max(called.cast("int")) == 1, last(here, called)).alias("call"),
    )
    out = ends.join(found, "log_id", "left").withColumn("fragment_start", F.coalesce("fragment_start", F.lit(1)))
    out = out.withColumn("site", F.when(F.col("site.line") >= F.col("fragment_start"), F.col("site")))
    return out.withColumn("call", F.coalesce("site", F.when(F.col("call.line") > F.coalesce("edge", F.lit(0)), F.col("call")))).drop("edge")


def in_window(inclusive: bool = False) -> Column:
    """States of a fragment before its call or site (or at it) whose pc that of the call does not precede."""
    line = F.col("log_line") <= F.col("call.line") if inclusive else F.col("log_line") < F.col("call.line")
    return F.coalesce((F.col("log_line") >= F.col("call.fragment")) & line & (F.col("pc") <= F.col("call.pc")), F.lit(False))


def windows(at: DataFrame, found: DataFrame) -> DataFrame:
    """The states of each log with its site, and flags: plain (no branch delta), before, at (the site's window), towards (up to the
    error instead of the site), last (bounded by the error's pc only), until (and by its line); and the frames of the windows."""
    point = at.select("log_id", F.col("pc").alias("t_pc"), F.col("line_no").alias("t_line"), "fragment_start", "call")
    rows = found.join(point, "log_id").withColumn("plain", F.col("kind") != "branch_delta").withColumn("before", in_window()).withColumn("at", in_window(True))
    by_pc = F.col("t_pc").isNull() | (F.col("pc") <= F.col("t_pc"))
    rows = rows.withColumn("towards", F.coalesce((F.col("log_line") >= F.col("call.fragment")) & (F.col("log_line") < F.col("t_line")) & (F.col("pc") <= F.col("call.pc")), F.lit(False)))
    rows = rows.withColumn("last", by_pc).withColumn("until", by_pc & (F.col("log_line") < F.col("t_line")))
    log = Window.partitionBy("log_id")
    frame = lambda cond: F.max_by("frame", F.when(cond, F.col("log_line"))).over(log)
    any_ = lambda cond: F.max(cond.cast("int")).over(log) == 1
    for name, cond in (("frame_plain", F.col("before") & F.col("plain")), ("frame_all", F.col("before")), ("frame_at", F.col("at"))):
        rows = rows.withColumn(name, F.when(any_(cond), frame(cond)))
    # the path to the site starts anew at a whole state and where the frame changes
    path = Window.partitionBy("log_id", "before").orderBy("log_line")
    resets = F.col("kind").isin(*FULL) | ~F.col("frame").eqNullSafe(F.lag("frame").over(path))
    return rows.withColumn("resets", F.col("before") & resets).withColumn("path_start", F.max(F.when(F.col("resets"), F.col("log_line"))).over(log))


def _in_frame(name: str) -> Column:
    return F.col(name).isNull() | (F.col("frame") == F.col(name))


def state_lookups(rows: DataFrame) -> DataFrame:
    """By log, of whole states: the one before the site and at it, the last with references, and the last before the error."""
    whole = F.struct("log_line", "pc", "frame", "kind", S.references(F.col("tokens")).alias("ref_ids"), S.reference_count(F.col("tokens")).alias("refs"), S.callback(F.col("tokens")).alias("callback"))
    pick = lambda cond: F.when(F.max(cond.cast("int")) == 1, F.max_by("whole", F.when(cond, F.col("log_line"))))
    plain = F.col("plain")
    rows = rows.withColumn("whole", whole)
    entered = F.col("from_pc").isNotNull() & (F.col("whole.callback") == "sync") & (F.col("log_line") >= F.col("call.fragment")) & (F.col("log_line") < F.col("call.line")) & (F.col("pc") <= F.col("call.pc"))
    return rows.groupBy("log_id").agg(
        pick(F.col("before") & plain).alias("state_before"), pick(F.col("at") & plain).alias("state_at"), pick(F.col("before") & plain & (F.size("whole.ref_ids") > 0)).alias("ref_state"),
        pick(F.col("until") & plain).alias("state_until"), pick(F.col("towards") & plain).alias("state_towards"), F.max("frame_plain").alias("frame"), F.max(F.when(F.col("log_line") >= F.col("path_start"), F.col("frame_all"))).alias("path_frame"),
        F.when(F.max(entered.cast("int")) == 1, F.max_by(F.struct("log_line", "from_pc"), F.when(entered, F.col("log_line")))).alias("callback_entry"),
    )


def registers(rows: DataFrame) -> DataFrame:
    """The registers of each state in long form, with all columns of `windows`."""
    long = rows.withColumn("r", F.explode(S.registers(F.col("tokens")))).select(*rows.columns, F.col("r.reg").alias("reg"), F.col("r.state").alias("state"))
    w = Window.partitionBy("log_id", "reg").orderBy("log_line").rowsBetween(Window.unboundedPreceding, -1)
    pointer = F.when(F.col("plain") & F.col("last") & R.pointer_like(F.col("state")), F.col("state.reg_type"))
    return long.withColumn("pointer_before", F.last(pointer, ignorenulls=True).over(w))


def register_lookups(long: DataFrame) -> DataFrame:
    """By log, a map from register to its look-ups, each null if there is none:

    before, before_all, at_all: the latest state in the site's window and frame, without and with branch deltas, and including the
    site; argument: before, or else up to the error; last: the latest by pc only; path: of the path to the site; loss, unsafe,
    nullable: what `last` was when it was last lost as a pointer, unsafe, or nullable; types_here, types_at_error: pointer types at
    the same pc; was_ctx. States come as (state, log_line, frame, source_frame, pc)."""
    value = F.struct("state", "log_line", "frame", F.coalesce("state.source_frame", "frame").alias("source_frame"), "pc")
    plain, kind = F.col("plain"), F.col("state.reg_type")
    seen = lambda v, cond: F.when(F.max(cond.cast("int")) == 1, F.max_by(v, F.when(cond, F.col("log_line"))))
    before = F.col("before") & plain & _in_frame("frame_plain")
    last = F.col("last") & plain
    unsafe = R.unsafe_state(F.col("state"))
    in_lines = (F.col("log_line") >= F.col("call.fragment")) & (F.col("log_line") < F.col("call.line"))
    by_register = long.withColumn("_v", value).groupBy("log_id", "reg").agg(
        seen("_v", before).alias("before"), seen("_v", F.col("before") & _in_frame("frame_all")).alias("before_all"), seen("_v", F.col("at") & _in_frame("frame_at")).alias("at_all"),
        F.coalesce(seen("_v", before), seen("_v", F.col("towards") & plain & _in_frame("frame_plain"))).alias("argument"), seen("_v", last).alias("last"), seen("_v", F.col("before") & (F.col("log_line") >= F.col("path_start"))).alias("path"),
        seen(F.struct("pc", F.col("pointer_before").alias("kind")), last & (kind == "scalar") & F.col("pointer_before").isNotNull()).alias("loss"), seen(F.struct("pc", "state"), last & unsafe).alias("unsafe"),
        seen(F.struct("pc", kind.alias("kind")), last & kind.contains("_or_null")).alias("nullable"), F.collect_set(F.when(in_lines & plain & (F.col("pc") == F.col("call.pc")) & R.pointer_like(F.col("state")), kind)).alias("types_here"),
        F.max((plain & (F.col("pc") == F.col("t_pc"))).cast("int")).alias("seen_at_error"), F.max((plain & (F.col("pc") == F.col("t_pc")) & R.pointer_like(F.col("state"))).cast("int")).alias("pointer_at_error"),
        F.max((in_lines & plain & (kind == "ctx")).cast("int")).alias("was_ctx"),
    )
    # eleven registers at most
    return by_register.groupBy("log_id").agg(F.map_from_entries(F.collect_list(F.struct("reg", F.struct(*(c for c in by_register.columns if c not in ("log_id", "reg")))))).alias("regs"))


def first_of_type(long: DataFrame, kind: str) -> DataFrame:
    """(log_id, reg): the lowest register of a type in the last state, by the error's pc, that has one."""
    rows = long.where(F.col("plain") & F.col("last") & (F.col("state.reg_type") == kind)).groupBy("log_id", "log_line").agg(F.min("reg").alias("reg"))
    return rows.groupBy("log_id").agg(F.max_by("reg", "log_line").alias("reg"))


def slot_lookups(rows: DataFrame) -> DataFrame:
    """By log, the stack of the path to the site: a map from offset to (slot_types, state). At most 64 slots of a frame."""
    path = rows.where(F.col("before") & (F.col("log_line") >= F.col("path_start"))).select("log_id", "log_line", F.explode(S.slots(F.col("tokens"))).alias("s"))
    value = F.struct("s.slot_types", F.when(F.col("s.value").isNotNull(), S.register_state(F.col("s.value"), F.lit(False))).alias("state"))
    latest = path.groupBy("log_id", "s.slot_off").agg(F.max_by(value, "log_line").alias("slot"))
    return latest.groupBy("log_id").agg(F.map_from_entries(F.collect_list(F.struct("slot_off", "slot"))).alias("slots"))


def initialized_bytes(slots: Column, start: Column) -> Column:
    """How many bytes from `start` on can be read, up to the top of the frame: zero and plain bytes, and spilled scalars."""

    def readable(offset: Column) -> Column:
        home = (F.floor(offset / 8) * 8).cast("int")
        slot = F.try_element_at(slots, home)
        scalar = F.coalesce(slot["state"]["reg_type"] == "scalar", F.lit(False))
        mark = F.substring(slot["slot_types"], (8 - (offset - home)).cast("int"), F.lit(1))
        return F.coalesce(F.when(slot["slot_types"].isNull(), scalar).otherwise(mark.isin("0", "m") | ((mark == "r") & scalar)), F.lit(False))

    offsets = F.when(start.between(-512, -1), F.sequence(start, F.lit(-1)))
    gap = F.array_min(F.filter(offsets, lambda o: ~readable(o)))
    return F.when(start.between(-512, -1), F.coalesce(gap, F.lit(0)) - start).otherwise(0)


# ---- sources ----

_WANTED = {
    "scalar_guard": T.is_scalar_guard, "packet_check": T.is_packet_check, "null_check": T.is_null_check, "nullable_return": T.is_nullable_return, "stack_init": T.is_stack_initialization, "acquire": T.is_acquire, "release": T.is_release,
    "branch": lambda t: t.contains("if (") & ~t.contains("data_end"), "data_end": lambda t: t.contains("data_end"), "volatile": lambda t: t.contains("volatile"), "bpf_call": lambda t: t.contains("bpf_"),
}


def source_lookups(at: DataFrame, events: DataFrame) -> DataFrame:
    """By log: rejected (the source of the error's pc, else the last one), site_source (of the site, in its fragment), n_sources, and
    for each kind of line the nearest one above the rejected line in its file, each as (pc, source)."""
    point = at.select("log_id", F.col("pc").alias("t_pc"), "fragment_start", F.col("call").alias("site"))
    rows = events.join(point, "log_id")
    place = F.struct("pc", "line_no")
    near = (F.col("line_no") >= F.col("fragment_start")) & (F.col("line_no") < F.col("site.line")) & (F.col("pc") <= F.col("site.pc"))
    fits = F.when(F.col("t_pc").isNull(), F.lit(True)).otherwise(F.coalesce(F.col("pc") <= F.col("t_pc"), F.lit(False)))
    by_pc = F.when(fits, F.struct(F.when(F.col("t_pc").isNotNull(), F.col("pc")).alias("pc"), "line_no"))
    first = rows.groupBy("log_id").agg(
        F.when(F.max(fits.cast("int")) == 1, F.max_by("source", by_pc)).alias("rejected"), F.when(F.max(near.cast("int")) == 1, F.max_by("source", F.when(near, place))).alias("site_source"), F.count("*").alias("n_sources"),
        F.max(((F.col("line_no") >= F.col("fragment_start")) & (F.col("pc") == 0) & entry_of_several(F.col("source.text"))).cast("int")).alias("multi_argument_entry"),
    )
    above = rows.select("log_id", "line_no", "pc", "source").join(first.select("log_id", "rejected"), "log_id").where((F.col("source.path") == F.col("rejected.path")) & (F.col("source.line") < F.col("rejected.line")))
    order = F.struct("source.line", "line_no")
    kinds = [F.when(F.max(f(F.col("source.text")).cast("int")) == 1, F.max_by(F.struct("pc", "source"), F.when(f(F.col("source.text")), order))).alias(n) for n, f in _WANTED.items()]
    return first.join(above.groupBy("log_id").agg(*kinds), "log_id", "left")


def entry_of_several(text: Column) -> Column:
    """A program's entry that takes several arguments."""
    t = F.ltrim(text)
    return (t.startswith("int ") | t.startswith("long ") | t.contains("BPF_PROG(") | t.contains("BPF_KPROBE(")) & t.contains("(") & t.contains(",")


def sources_at(points: DataFrame, events: DataFrame, name: str = "source") -> DataFrame:
    """(log_id, at_pc, source) of points (log_id, at_pc): the source of the greatest pc up to the point's; of equal ones the last."""
    rows = points.where("at_pc is not null").distinct().join(events, "log_id").where("pc <= at_pc")
    return rows.groupBy("log_id", "at_pc").agg(F.max_by("source", F.struct("pc", "line_no")).alias(name))


# ---- instructions ----


def depth_before(all_lines: DataFrame, at: DataFrame, opens: tuple, closes: tuple, name: str) -> DataFrame:
    """(log_id, depth): calls that open less calls that close, never below zero, in the fragment before the site."""
    from .asof import floored_depth

    point = at.select("log_id", F.col("call.fragment").alias("fragment_start"), F.col("call").alias("site"))
    rows = all_lines.join(point, "log_id").where("line_no >= fragment_start and line_no < site.line").select("log_id", "line_no", I.call_target(I.tail(F.trim("line"))).alias("target"))
    rows = rows.where(F.col("target").isin(*opens, *closes))
    deep = floored_depth(rows, F.when(F.col("target").isin(*opens), 1).otherwise(-1), ["log_id"], ["line_no"])
    return deep.groupBy("log_id").agg(F.max_by("depth", "line_no").alias(name))


def assignments(all_lines: DataFrame, at: DataFrame, found: DataFrame) -> DataFrame:
    """(log_id, line_no, pc, tail, frame): instructions of each log's fragment before its site, with the frame that each ran in (null if
    no state says so): that of the latest state before it whose pc is not beyond."""
    point = at.select("log_id", F.col("call.fragment").alias("fragment_start"), F.col("call").alias("site"))
    rows = all_lines.join(point, "log_id").where("line_no >= fragment_start and line_no < site.line").select("log_id", "line_no", I.pc(F.trim("line")).alias("pc"), I.tail(F.trim("line")).alias("tail")).where("tail is not null")
    marks = found.where("kind <> 'branch_delta'").join(point, "log_id").where("log_line >= fragment_start and log_line < site.line").select("log_id", F.col("log_line").alias("line_no"), F.lit(None).cast("int").alias("pc"), F.lit(None).cast("string").alias("tail"), F.col("frame"), F.lit(0).alias("_tag"))
    both = marks.unionByName(rows.withColumn("frame", F.lit(None).cast("int")).withColumn("_tag", F.lit(-1)))
    w = Window.partitionBy("log_id").orderBy("line_no", "_tag").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("frame", F.last("frame", ignorenulls=True).over(w)).where("tail is not null").drop("_tag")


def traced_back(rows: DataFrame, start: DataFrame, hops: int = 8) -> DataFrame:
    """(log_id, hop, reg, line_no, pc, tail): the chain of assignments from which a register's value comes, the latest first.

    start: log_id, reg, frame, before_line. Each hop is one join and one aggregate, written as a table, and goes on from the source of a
    whole copy; the search ends when no log has a further hop."""
    current, out = start, []
    for hop in range(hops + 1):
        met = current.join(rows.withColumnRenamed("frame", "_frame"), "log_id").where((F.col("line_no") < F.col("before_line")) & I.assigns(F.col("tail"), F.col("reg")) & (F.col("_frame").isNull() | (F.col("_frame") == F.col("frame"))))
        step = kept(met.groupBy("log_id", "reg", "frame").agg(F.max_by(F.struct("line_no", "pc", "tail"), "line_no").alias("a")).select("log_id", F.lit(hop).alias("hop"), "reg", "frame", "a.*"))
        out.append(step)
        if step.isEmpty():
            break
        current = step.where(I.destination(F.col("tail")) == F.col("reg")).select("log_id", I.copy_source(F.col("tail")).alias("reg"), "frame", F.col("line_no").alias("before_line")).where("reg is not null")
    return reduce(DataFrame.unionByName, out)


# ---- the whole ----


class Tables:
    """What a log's analysis reads again and again, each written once: sites, states, registers and slots in long form, quoted sources and
    the instructions of the fragments. Later steps start from these tables, not from the lines."""

    def __init__(self, all_lines: DataFrame, classified: DataFrame):
        from . import logs

        def found():
            self.malformed = kept(states.malformed_logs(all_lines))
            self.found = kept(states.usable_states(all_lines, malformed=self.malformed))

        def of_windows():
            self.windows = kept(windows(self.at, self.found))
            self.registers = kept(registers(self.windows))

        spark, self.lines = all_lines.sparkSession, all_lines
        self.at, self.events, _ = together(spark, lambda: kept(sites(all_lines, classified)), lambda: kept(logs.source_events(all_lines)), found)
        _, self.slots, self.instructions = together(spark, of_windows, lambda: kept(slots_of(self.found)), lambda: kept(assignments(all_lines, self.at, self.found)))


def contexts(t: Tables) -> DataFrame:
    """A row for each classified terminal with all of the look-ups above, as a table.

    Logs with a malformed state line have no states at all: `malformed` says so, and no look-up of theirs is set."""
    bad = t.malformed.withColumn("malformed", F.lit(True))
    steps = [lambda: state_lookups(t.windows), lambda: slot_lookups(t.windows), lambda: source_lookups(t.at, t.events), *(lambda k=k: first_of_type(t.registers, k).withColumnRenamed("reg", f"first_{k}") for k in ("scalar", "map_value"))]
    *parts, regs = together(t.lines.sparkSession, *(lambda s=s: kept(s()) for s in steps), lambda: kept(register_lookups(t.registers)))
    # the widest part comes last
    out = t.at.join(side_by_side([*parts, bad], "log_id"), "log_id", "left").join(regs, "log_id", "left")
    return kept(out.withColumn("malformed", F.coalesce("malformed", F.lit(False))).withColumn("register", M.register(F.col("message"))))


def registers_before(points: DataFrame, found: DataFrame, long: DataFrame, inclusive: bool = False) -> DataFrame:
    """Adds to points (log_id, point_id, p_line, p_pc, p_from, reg) the latest state of the register before the point (or at it), of
    the frame of the latest whole state there: seen (state, log_line, frame, source_frame), null if there is none.

    Two ordered look-ups, by line and pc: of the latest whole state, which tells the frame, and of the register's latest state in that
    frame. Both pass narrow rows of lines only, so a log of many states and many points costs their sum and not their product."""
    from .asof import latest_line_below

    key = ["log_id", "point_id"]
    place = points.select(*key, "reg", "p_from", F.col("p_line").alias("log_line"), F.col("p_pc").alias("pc"))
    whole = found.select("log_id", "log_line", "pc", F.col("frame").alias("_frame"))
    at = latest_line_below(place.select("log_id", "point_id", "log_line", "pc"), whole, ["log_id"], key, inclusive=inclusive, name="_whole").where("_whole is not null")
    framed = place.join(at.select(*key, "_whole"), key).where("_whole >= p_from").join(whole.select("log_id", F.col("log_line").alias("_whole"), "_frame"), ["log_id", "_whole"])
    framed = framed.select(*key, "reg", "p_from", "log_line", "pc", F.col("_frame").alias("frame")).where("reg is not null")
    near = latest_line_below(framed, long.select("log_id", "reg", "frame", "log_line", "pc"), ["log_id", "reg", "frame"], key, inclusive=inclusive, name="_line").where("_line >= p_from")
    states_ = long.select("log_id", "reg", F.col("log_line").alias("_line"), F.col("frame").alias("_state_frame"), "state")
    value = F.struct("state", F.col("_line").alias("log_line"), F.col("_state_frame").alias("frame"), F.coalesce("state.source_frame", "_state_frame").alias("source_frame"))
    seen = near.select(*key, "reg", "_line").join(states_, ["log_id", "reg", "_line"]).select(*key, value.alias("seen"))
    return points.join(seen, key, "left")


def slots_of(found: DataFrame) -> DataFrame:
    """(log_id, log_line, pc, frame, ref_ids, slot_off, slot_types, slot): the slots of each state in long form; slot is the value's state."""
    rows = found.where("kind <> 'branch_delta'").select("log_id", "log_line", "pc", "frame", S.references(F.col("tokens")).alias("ref_ids"), F.explode(S.slots(F.col("tokens"))).alias("s"))
    return rows.select("log_id", "log_line", "pc", "frame", "ref_ids", "s.slot_off", "s.slot_types", F.when(F.col("s.value").isNotNull(), S.register_state(F.col("s.value"), F.lit(False))).alias("slot"))


def slot_overlaps(accesses: DataFrame, slots: DataFrame) -> DataFrame:
    """Of each access, what its bytes met in the newest state that has a slot among them:

    accesses: log_id, access_id, a_start, a_end, a_frame, a_from, a_pc, a_line, a_type (the start of the types that it looks for),
    a_size (bytes of such a slot; others have eight). Result: log_id, access_id, at_line, target (such a slot covers the start or lies
    inside), exact (one starts there), interior (one covers the start), live (such a slot's reference is among the state's),
    any_live, target_refs, irq (the slot at the start is an interrupt flag, null if none starts there), covered."""
    is_target = F.coalesce(F.col("slot.reg_type").startswith(F.col("a_type")), F.lit(False))
    met = accesses.join(slots, "log_id").where((F.col("frame") == F.col("a_frame")) & (F.col("log_line") >= F.col("a_from")) & (F.col("log_line") < F.col("a_line")) & (F.col("a_pc").isNull() | (F.col("pc") <= F.col("a_pc"))))
    met = met.withColumn("is_target", is_target).withColumn("s_end", F.col("slot_off") + F.when(F.col("is_target"), F.col("a_size")).otherwise(8)).where((F.col("slot_off") < F.col("a_end")) & (F.col("a_start") < F.col("s_end")))
    newest = Window.partitionBy("log_id", "access_id").orderBy(F.desc("log_line"))
    met = met.withColumn("n", F.rank().over(newest)).where("n = 1")
    covers = (F.col("slot_off") <= F.col("a_start")) & (F.col("a_start") < F.col("s_end"))
    inside = (F.col("slot_off") >= F.col("a_start")) & (F.col("s_end") <= F.col("a_end"))
    live = F.col("is_target") & F.coalesce(F.array_contains("ref_ids", F.col("slot.ref_id").cast("long")), F.lit(False))
    at_start = F.col("slot_off") == F.col("a_start")
    return met.groupBy("log_id", "access_id").agg(
        F.max("log_line").alias("at_line"), F.max((F.col("is_target") & (covers | inside)).cast("int")).alias("target"), F.max((F.col("is_target") & at_start).cast("int")).alias("exact"), F.max((F.col("is_target") & covers & ~at_start).cast("int")).alias("interior"),
        F.max((live & at_start).cast("int")).alias("live"), F.max(live.cast("int")).alias("any_live"), F.max(F.col("is_target").cast("int")).alias("any_target"), F.collect_set(F.when(F.col("is_target"), F.col("slot.ref_id").cast("long"))).alias("target_refs"),
        F.max(F.when(at_start, (F.col("slot").isNull() & (F.col("slot_types") == "ffffffff")).cast("int"))).alias("irq"), F.max(covers.cast("int")).alias("covered"),
    )

"""Control flow of programs held as tables: instructions (program, pc, insn), blocks, edges, frames and rates.

A program's instructions are rows; pcs count slots, of which a wide load takes two. Nothing needs a program in one piece."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bytecode as B
from ..functions import kinsn as K
from ..functions import states as S


def instructions(sections: DataFrame) -> DataFrame:
    """(program, pc, insn, high): instructions of byte strings (program, code); high is a wide load's second immediate. Slots that belong
    to the instruction before them are no instructions, whatever they hold."""
    slots = sections.select("program", F.posexplode(F.transform(F.sequence(F.lit(0), (F.length("code") / 8).cast("int") - 1), lambda k: B.decoded(F.substring(F.col("code"), k * 8 + 1, F.lit(8))))).alias("pc", "insn"))
    w = Window.partitionBy("program").orderBy("pc")
    wide = F.col("insn.code") == B.LDIMM64
    # of a run of slots that look wide every second one is the end of the one before
    runs = slots.withColumn("wide", wide).withColumn("run", F.sum((~wide).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.row_number().over(Window.partitionBy("program", "run").orderBy("pc")) - F.when(F.col("run") == 0, 0).otherwise(1)
    runs = runs.withColumn("at", at)
    before = F.lag(F.struct("wide", "at")).over(w)
    second = F.coalesce(before["wide"] & (before["at"] % 2 == 1), F.lit(False))
    rows = runs.withColumn("second", second).withColumn("high", F.when(wide, F.lead("insn.imm").over(w)))
    return rows.where(~F.col("second")).select("program", "pc", "insn", "high")


def block_starts(rows: DataFrame) -> DataFrame:
    """(program, pc): starts of blocks: the first pc, targets of jumps and calls, and what follows a terminator."""
    i, pc = F.col("insn"), F.col("pc")
    last = F.max("pc").over(Window.partitionBy("program"))
    ends = is_terminator(i)
    found = rows.withColumn("last", last).select("program", "last", F.explode(F.array(F.when(pc == 0, F.lit(0)), B.branch_target(i, pc), B.relative_target(i, pc), F.when(ends & ~B.loads_function(i), pc + B.width(i["code"])))).alias("pc"))
    return found.where("pc is not null and pc <= last").select("program", "pc").distinct()


def is_terminator(i: Column) -> Column:
    return B.is_exit(i["code"]) | B.is_jump(i["code"]) | B.is_conditional(i["code"]) | B.is_pseudo_call(i)


def function_starts(rows: DataFrame) -> DataFrame:
    """(program, pc): starts of functions: the first pc and all that calls and references name."""
    named = rows.select("program", B.relative_target(F.col("insn"), F.col("pc")).alias("pc")).where("pc is not null")
    return named.unionByName(rows.where("pc = 0").select("program", "pc")).distinct()


def numbered(rows: DataFrame, starts: DataFrame, name: str) -> DataFrame:
    """Adds to each row how many starts lie at or before it, from 0: its block, or its frame."""
    marks = starts.select("program", "pc", F.lit(1).alias("_start"))
    w = Window.partitionBy("program").orderBy("pc").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(marks, ["program", "pc"], "left").withColumn(name, F.sum(F.coalesce("_start", F.lit(0))).over(w) - 1).drop("_start")


def placed(rows: DataFrame) -> DataFrame:
    """Adds block and frame to instructions (program, pc, insn, ...): as `numbered` by `block_starts` and `function_starts`.

    What an instruction says of starts travels with it, so that starts and instructions meet in one shuffle by program, read in order."""
    i, pc = F.col("insn"), F.col("pc")
    rest = [c for c in rows.columns if c != "program"]
    none = F.lit(None).cast(rows.select(F.struct(*rest).alias("r")).schema["r"].dataType)
    mark = lambda at, of_frame: F.struct(at.cast("long").alias("at"), F.lit(0).alias("tag"), F.lit(of_frame).alias("of_frame"), none.alias("row"))
    behind = F.when(is_terminator(i) & ~B.loads_function(i), pc + B.width(i["code"]))
    marks = F.filter(F.array(mark(F.when(pc == 0, pc), True), mark(B.branch_target(i, pc), False), mark(B.relative_target(i, pc), True), mark(behind, False)), lambda x: x["at"].isNotNull())
    own = F.struct(pc.cast("long").alias("at"), F.lit(1).alias("tag"), F.lit(False).alias("of_frame"), F.struct(*rest).alias("row"))
    met = rows.select("program", F.inline(F.concat(marks, F.array(own))))
    w = Window.partitionBy("program").orderBy("at", "tag").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.max(F.when((F.col("tag") == 0) & c, F.col("at"))).over(w)
    met = met.withColumns({"_block": last(F.lit(True)), "_frame": last(F.col("of_frame"))})
    count = lambda c: F.sum(((F.col("tag") == 1) & F.coalesce(F.col(c) == F.col("at"), F.lit(False))).cast("int")).over(w) - 1
    met = met.withColumns({"block": count("_block"), "frame": count("_frame")}).where("tag = 1")
    return met.select(*(F.col(f"row.{c}") if c != "program" else F.col(c) for c in rows.columns), "block", "frame")


def blocks(rows: DataFrame) -> DataFrame:
    """(program, block, start, last, frame, terminator): each block with the instruction it ends with; a block without a jump falls
    through to the next, or ends the program."""
    return blocks_of(placed(rows))


def blocks_of(parts: DataFrame) -> DataFrame:
    """As `blocks`, of instructions that have block and frame."""
    out = parts.groupBy("program", "block").agg(F.min("pc").alias("start"), F.max("pc").alias("last"), F.min("frame").alias("frame"), F.max_by("insn", "pc").alias("insn"))
    i = F.col("insn")
    final = F.col("block") == F.max("block").over(Window.partitionBy("program"))
    kind = F.when(B.is_exit(i["code"]), "exit").when(B.is_pseudo_call(i), "call").when(B.is_jump(i["code"]), "jump").when(B.is_conditional(i["code"]), "branch").when(final, "end").otherwise("fallthrough")
    return out.withColumn("terminator", kind)


def successors(found: DataFrame) -> DataFrame:
    """(program, src, dst, kind): edges between blocks; a call has its callee and the block it returns to."""
    i, last = F.col("insn"), F.col("last")
    after = last + B.width(i["code"])
    to = (
        F.when(F.col("terminator") == "jump", F.array(F.struct(B.branch_target(i, last).alias("pc"), F.lit("jump").alias("kind"))))
        .when(F.col("terminator") == "branch", F.array(F.struct(B.branch_target(i, last).alias("pc"), F.lit("taken").alias("kind")), F.struct((last + 1).alias("pc"), F.lit("fallthrough").alias("kind"))))
        .when(F.col("terminator") == "call", F.array(F.struct(B.relative_target(i, last).alias("pc"), F.lit("callee").alias("kind")), F.struct((last + 1).alias("pc"), F.lit("return").alias("kind"))))
        .when(F.col("terminator") == "fallthrough", F.array(F.struct(after.alias("pc"), F.lit("fallthrough").alias("kind"))))
    )
    edges = found.select("program", F.col("block").alias("src"), F.explode(to).alias("t")).select("program", "src", F.col("t.pc").alias("start"), "t.kind")
    return edges.join(found.select("program", "start", F.col("block").alias("dst")), ["program", "start"]).select("program", "src", "dst", "kind")


def states_by_site(rows: DataFrame, states: DataFrame) -> DataFrame:
    """(program, pc, state_pc, kind): states (program, pc, kind) with the instruction they are of. A delta that names the second slot of
    a wide load belongs to the next instruction; others need an instruction at their own pc."""
    w = Window.partitionBy("program").orderBy(F.desc("pc"), "tag").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.select("program", "pc", F.lit(0).alias("tag"), F.lit(None).cast("string").alias("kind")).unionByName(states.select("program", "pc", F.lit(1).alias("tag"), "kind"))
    met = both.withColumn("site", F.last(F.when(F.col("tag") == 0, F.col("pc")), ignorenulls=True).over(w)).where("tag = 1")
    return met.where((F.col("site") == F.col("pc")) | F.col("kind").endswith("delta")).where("site is not null").select("program", F.col("site").alias("pc"), F.col("pc").alias("state_pc"), "kind")


def previous_definition(rows: DataFrame, points: DataFrame) -> DataFrame:
    """Adds to points (program, frame, pc, reg) the nearest pc before, in the frame, that writes the register."""
    made = rows.select("program", "frame", F.col("pc"), F.explode(B.defs(F.col("insn"))).alias("reg"))
    from .asof import latest

    return latest(points, made, ["program", "frame", "reg"], "pc", F.col("pc"), name="defined_at")


def map_bindings(rows: DataFrame) -> DataFrame:
    """(program, pc, how, fd, map_index): loads of maps; maps are numbered in the order in which the program first names them."""
    how = B.map_pseudo(F.col("insn"))
    found = rows.select("program", "pc", how.alias("how"), F.col("insn.imm").alias("fd")).where("how is not null")
    first = F.min("pc").over(Window.partitionBy("program", "fd"))
    return found.withColumn("first", first).withColumn("map_index", F.dense_rank().over(Window.partitionBy("program").orderBy("first")) - 1).drop("first")


def map_of_immediate(bindings: DataFrame) -> DataFrame:
    """(program, fd, map_index): the first binding of each immediate."""
    return bindings.groupBy("program", "fd").agg(F.min_by("map_index", "pc").alias("map_index"))


def slot_counts(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """(range_id, slots): slots of the blocks from first to last (range_id, program, first_block, last_block); rows have block."""
    met = ranges.join(rows.groupBy("program", "block").agg(F.sum(B.width(F.col("insn.code"))).alias("n")), "program").where("block between first_block and last_block")
    return met.groupBy("range_id").agg(F.sum("n").alias("slots"))


def entry_sites(edges: DataFrame) -> DataFrame:
    """(program, block): blocks that a jump or branch enters."""
    return edges.where(F.col("kind").isin("jump", "taken", "fallthrough")).select("program", F.col("dst").alias("block")).distinct()


def matches(rows: DataFrame, patterns: tuple) -> DataFrame:
    """(program, block, pc): places where instructions of a block, one after the other, meet the conditions (functions of an instruction)."""
    w = Window.partitionBy("program", "block").orderBy("pc")
    fits = patterns[0](F.col("insn"))
    for k, p in enumerate(patterns[1:], 1):
        fits = fits & F.coalesce(p(F.lead("insn", k).over(w)), F.lit(False))
    return rows.withColumn("_fits", fits).where("_fits").select("program", "block", "pc")


def reaching_definitions(found: DataFrame, rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(program, block, pc, reg, at): for each use of a register the definitions that reach it, by a fixpoint over blocks.

    rows have block. What leaves a block is its last definition of each register, and what enters it and is not written there."""
    from .storage import cut

    made = rows.select("program", "block", "pc", F.explode(B.defs(F.col("insn"))).alias("reg"))
    last = cut(made.groupBy("program", "block", "reg").agg(F.max("pc").alias("at")))
    kills = last.select("program", "block", "reg")
    edges = cut(edges.select("program", F.col("src").alias("block"), "dst").distinct())
    entering, new = None, last
    while True:
        moved = new.join(edges, ["program", "block"]).select("program", F.col("dst").alias("block"), "reg", "at").distinct()
        moved = moved if entering is None else moved.join(entering, ["program", "block", "reg", "at"], "left_anti")
        moved = cut(moved)
        if moved.isEmpty():
            break
        entering = moved if entering is None else entering.unionByName(moved)
        new = moved.join(kills, ["program", "block", "reg"], "left_anti")
    read = rows.select("program", "block", "pc", F.explode(B.uses(F.col("insn"))).alias("reg"))
    own = read.join(made.withColumnRenamed("pc", "at"), ["program", "block", "reg"]).where("at < pc").groupBy("program", "block", "pc", "reg").agg(F.max("at").alias("at"))
    if entering is None:
        return own
    outside = read.join(own.drop("at"), ["program", "block", "pc", "reg"], "left_anti").join(entering, ["program", "block", "reg"])
    return own.unionByName(outside.select("program", "block", "pc", "reg", "at"))


def rate(taken: Column, not_taken: Column) -> Column:
    """The share of a branch's visits that took it; null without any."""
    return F.try_divide(taken.cast("double"), taken + not_taken)


def miss_rate(value: Column) -> Column:
    """A measured rate, if it is a number."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


# ---- sites: places in blocks ----


def site_pcs(sites: DataFrame) -> DataFrame:
    """Adds current_pc to sites (program, block, index, insn) in their present order: the slots of all before them."""
    w = Window.partitionBy("program").orderBy("block", "index").rowsBetween(Window.unboundedPreceding, -1)
    return sites.withColumn("current_pc", F.coalesce(F.sum(B.width(F.col("insn.code"))).over(w), F.lit(0)))


def sites_of(rows: DataFrame) -> DataFrame:
    """(program, pc, block, index): where each instruction (with block) stands in its block, from 0."""
    return rows.select("program", "pc", "block", (F.row_number().over(Window.partitionBy("program", "block").orderBy("pc")) - 1).alias("index"))


def moved_pcs(sites: DataFrame) -> DataFrame:
    """(program, old_pc, new_pc) of sites that kept their old pc (program, block, index, insn, pc)."""
    return site_pcs(sites).select("program", F.col("pc").alias("old_pc"), F.col("current_pc").alias("new_pc"))


def remapped(records: DataFrame, moved: DataFrame) -> DataFrame:
    """(program, old_pc, new_pc, problem) of records (program, old_pc): gone where no instruction has the pc any more, disordered where the
    new pcs do not grow with the old ones."""
    met = records.join(moved, ["program", "old_pc"], "left")
    before = F.lag("new_pc").over(Window.partitionBy("program").orderBy("old_pc"))
    return met.withColumn("problem", F.when(F.col("new_pc").isNull(), "gone").when(before >= F.col("new_pc"), "disordered"))


def sized_records(tables: DataFrame) -> DataFrame:
    """Tables of records (program, name, n_bytes, record_size) whose bytes are no whole number of records, or whose size is none."""
    return tables.where((F.col("record_size") <= 0) | (F.col("n_bytes") % F.greatest("record_size", F.lit(1)) != 0))


def around(rows: DataFrame, anchors: DataFrame, before: int, after: int) -> DataFrame:
    """(program, anchor, pc, distance): the instructions of an anchor's frame (program, frame, anchor) up to so many before and behind it."""
    placed = rows.withColumn("_n", F.row_number().over(Window.partitionBy("program", "frame").orderBy("pc")))
    at = placed.join(anchors, ["program", "frame"]).where("pc = anchor").select("program", "frame", "anchor", F.col("_n").alias("_at"))
    met = placed.join(at, ["program", "frame"]).withColumn("distance", F.col("_n") - F.col("_at"))
    return met.where((F.col("distance") >= -before) & (F.col("distance") <= after)).select("program", "anchor", "pc", "distance")


def with_profile(found: DataFrame, profile: DataFrame) -> DataFrame:
    """Measured branches (program, pc, taken, not_taken) at the blocks that end there; problem says where no branch does."""
    ends = found.where("terminator = 'branch'").select("program", F.col("last").alias("pc"), "block")
    met = profile.join(ends, ["program", "pc"], "left")
    return met.select("program", "pc", "block", rate(F.col("taken"), F.col("not_taken")).alias("rate"), F.when(F.col("block").isNull(), "no branch").alias("problem"))


def live_behind(live: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_id, regs): registers live at the node behind each window (window_id, node), from (node, var)."""
    return windows.join(live, "node", "left").groupBy("window_id").agg(F.sort_array(F.collect_set("var")).alias("regs"))


def known_kinds(states: DataFrame) -> DataFrame:
    """(program, pc, reg, kind): the kind of a register at a site if all its states there agree on one."""
    kind = F.when(F.col("reg_type") == "scalar", "scalar").when(F.col("reg_type") == "fp", "stack").when(F.col("reg_type").startswith("map_value"), "map_value").when(F.col("reg_type").startswith("pkt"), "packet").when(F.col("reg_type") == "ctx", "context").otherwise("other")
    from .asof import agreed

    return agreed(states.withColumn("kind", kind), ["program", "pc", "reg"], "kind")


def known_constants(states: DataFrame) -> DataFrame:
    """(program, pc, reg, value): the value that all states after an instruction (kind insn_delta) agree on."""
    from .asof import agreed

    return agreed(states.where("state_kind = 'insn_delta'").withColumnRenamed("exact", "value"), ["program", "pc", "reg"], "value").where("value is not null")


def known_stack_bytes(found: DataFrame, asked: DataFrame) -> DataFrame:
    """(program, pc, reg, width, bytes): the bytes behind a stack pointer, as hexadecimal digits, where all visits of a site agree on them.

    found: states (program, pc, kind, tokens); asked: (program, pc, reg, width). Each byte comes from the slot that covers it. A visit that
    enters over an edge, has no stack pointer in the register, or leaves one byte open, leaves the site's bytes open."""
    from .asof import agreed
    from .states import once_for_each, with_states
    from .storage import kept

    site = ["program", "pc", "reg", "width"]
    met = asked.join(found.select("program", "pc", "kind", "tokens"), ["program", "pc"])
    met = kept(met.select(*site, "kind", S.text_of(F.col("tokens"), F.col("reg")).alias("_p"), S.slots(F.col("tokens")).alias("_slots")))
    met = with_states(met.select(*site, "kind", "_slots", F.col("_p.value").alias("_pointer"), F.col("_p.narrow").alias("_narrow")), {"_pointer": "_narrow"})
    start = F.when((F.col("_pointer_state.reg_type") == "fp") & (F.col("kind") != "edge_full"), F.coalesce("_pointer_state.off", F.lit(0)))
    met = met.select(*site, start.alias("_start"), "_slots")
    near = F.filter("_slots", lambda x: x["slot_off"].between(F.col("_start") - 7, F.col("_start") + F.col("width") - 1))
    met = kept(met.select(*site, "_start", near.alias("_near")))
    stack = F.map_from_entries(F.transform("_near", lambda x: F.struct(x["slot_off"], F.struct(x["slot_types"].alias("slot_types"), F.when(x["value"].isNotNull(), S.register_state(x["value"], F.lit(False))).alias("state")))))
    digits = F.transform(F.sequence(F.col("_start"), F.col("_start") + F.col("width") - 1), lambda o: F.lower(F.lpad(F.hex(S.stack_byte(F.col("_stack"), o).cast("long")), 2, "0")))
    whole = F.when(F.forall(digits, lambda x: x.isNotNull()), F.array_join(digits, ""))
    met = once_for_each(met, ["_start", "width", "_near"], lambda texts: texts.withColumn("_stack", stack).select("_start", "width", "_near", whole.alias("bytes")))
    return agreed(met, site, "bytes")


# ---- calls of kernel instructions ----


def kinsn_operands(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """(program, pc, target, role, reg, problem) of calls of kernel instructions: what each reads (use) and writes (def).

    registry: (call_imm, call_off, target), which pair of a call's numbers names which target. problem, with role and reg null: `no
    operands` where the instruction before, in the block, is not the move that carries them; `unknown call`; `bad register`. A target that
    writes nothing has no row for it. The dimension is a few dozen rows and the registry one for each target, so both are broadcast."""
    found = placed(rows)
    before = F.lag("insn").over(Window.partitionBy("program", "block").orderBy("pc"))
    i = F.col("insn")
    calls = found.withColumn("_before", before).where(is_kinsn_call(i))
    carried = F.coalesce(is_sidecar(F.col("_before")), F.lit(False))
    calls = calls.select("program", "pc", i["imm"].alias("call_imm"), i["off"].alias("call_off"), F.when(carried, K.payload(F.col("_before"))).alias("_payload"))
    known = calls.join(F.broadcast(registry.select("call_imm", "call_off", "target")), ["call_imm", "call_off"], "left")
    met = known.join(F.broadcast(K.descriptors(rows.sparkSession)), "target", "left")
    p = F.col("_payload")
    counts = F.coalesce(K.applies(p, F.col("mode"), F.col("flag")), F.lit(False)) & F.col("role").isNotNull()
    reg = K.register(p, F.col("shift"))
    problem = F.when(p.isNull(), "no operands").when(F.col("target").isNull(), "unknown call").when(counts & (reg > 10), "bad register")
    out = met.select("program", "pc", "target", problem.alias("problem"), F.when(problem.isNull() & counts, F.col("role")).alias("role"), F.when(problem.isNull() & counts, reg).alias("reg"))
    return out.where("role is not null or problem is not null").distinct().select("program", "pc", "target", "role", "reg", "problem")


def is_kinsn_call(i: Column) -> Column:
    return B.is_call(i["code"]) & (i["src"] == B.PSEUDO_KINSN)


def is_sidecar(i: Column) -> Column:
    """A move that only carries the operands of the kernel instruction called behind it."""
    return (i["code"] == B.MOVE_IMM) & (i["src"] == B.SIDECAR)


def uses_and_defs(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """(program, pc, role, reg) of all instructions: by their codes, but for calls of kernel instructions by their descriptors; the move
    before such a call is part of it and neither reads nor writes."""
    i = F.col("insn")
    carries = F.lead(is_kinsn_call(i)).over(Window.partitionBy("program").orderBy("pc"))
    plain = rows.withColumn("_carries", F.coalesce(carries, F.lit(False)) & is_sidecar(i)).where(~F.col("_carries") & ~is_kinsn_call(i))
    both = F.concat(F.transform(B.uses(i), lambda r: F.struct(F.lit("use").alias("role"), r.cast("int").alias("reg"))), F.transform(B.defs(i), lambda r: F.struct(F.lit("def").alias("role"), r.cast("int").alias("reg"))))
    named = plain.select("program", "pc", F.explode(both).alias("x")).select("program", "pc", "x.role", "x.reg")
    return named.unionByName(kinsn_operands(rows, registry).where("problem is null").select("program", "pc", "role", "reg"))

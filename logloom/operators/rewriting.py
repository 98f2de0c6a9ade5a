"""Programs without what control never reaches, and without jumps that only lead on: whole tables of programs at a time.

Blocks that fall through to each other must stay next to each other: they are a run. A jump at the end of one run to the start of another
that nothing else reaches can go if that run moves behind it; so runs form chains, and places in a chain come from pointer jumping.
Pcs are then sums of widths over chains, runs and blocks, and every relative operand is computed anew. Programs stay tables of
instructions throughout; nothing is edited in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bytecode as B
from . import cfg, graph
from .storage import cut, kept

FALLS = ("fallthrough", "branch", "call")


def references(rows: DataFrame) -> DataFrame:
    """(program, pc, target): instructions that name a function of their program by address."""
    return rows.where(B.loads_function(F.col("insn"))).select("program", "pc", B.relative_target(F.col("insn"), F.col("pc")).alias("target"))


def without_unreachable(rows: DataFrame) -> DataFrame:
    """Instructions (program, pc, insn, high) of the blocks that the first one reaches: over jumps, branches, calls and references."""
    placed = kept(cfg.placed(rows))
    blocks = cfg.blocks_of(placed)
    starts = blocks.select("program", F.col("start").alias("target"), F.col("block").alias("dst"))
    named = references(placed).join(placed.select("program", "pc", F.col("block").alias("src")), ["program", "pc"]).join(starts, ["program", "target"])
    edges = cfg.successors(blocks).select("program", "src", "dst").unionByName(named.select("program", "src", "dst"))
    node = lambda c: F.struct("program", F.col(c).cast("long").alias("block"))
    seen = graph.reachable(edges.select(node("src").alias("src"), node("dst").alias("dst")), placed.where("pc = 0").select(node("block").alias("node")))
    return placed.join(seen.select("node.program", F.col("node.block").cast("int").alias("block")), ["program", "block"], "left_semi").select("program", "pc", "insn", "high")


def _target(i: Column, pc: Column) -> Column:
    """The pc that a relative operand names."""
    return F.coalesce(B.branch_target(i, pc), B.relative_target(i, pc))


def compacted(rows: DataFrame) -> DataFrame:
    """(program, pc, insn, high, old_pc, problem): programs without unreachable blocks and without jumps to what only they reach.

    problem is `too far` where a branch would need more than 16 bits; its operand is then null, as in all other rows it is not."""
    live = cut(without_unreachable(rows))
    # blocks keep the borders that they had: a start is a start though the jump to it goes
    placed = cut(cfg.numbered(live, cfg.block_starts(rows).join(live.select("program", "pc"), ["program", "pc"], "left_semi"), "block"))
    ends = placed.groupBy("program", "block").agg(F.min("pc").alias("start"), F.max_by(F.struct("pc", "insn"), "pc").alias("e"))
    i, pc = F.col("e.insn"), F.col("e.pc")
    ends = ends.withColumn("jump", F.when(B.is_jump(i["code"]), B.branch_target(i, pc)))
    ends = cut(ends.withColumn("ends_run", B.is_exit(i["code"]) | F.col("jump").isNotNull()))
    before = Window.partitionBy("program").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    runs = ends.withColumn("run", F.coalesce(F.sum(F.col("ends_run").cast("int")).over(before), F.lit(0)))
    runs = cut(runs.withColumn("run_start", F.min("start").over(Window.partitionBy("program", "run"))))
    # how often each start is named, or fallen into
    named = placed.select("program", _target(F.col("insn"), F.col("pc")).alias("start")).where("start is not null")
    counts = named.groupBy("program", "start").agg(F.count("*").alias("n"))
    jumps = runs.where("jump is not null and jump > 0").select("program", F.col("run").alias("node"), F.col("jump").alias("start"), F.col("e.pc").alias("at"))
    heads = runs.where("start = run_start").select("program", "start", F.col("run").alias("next"))
    links = cut(jumps.join(heads, ["program", "start"]).join(counts.where("n = 1"), ["program", "start"]).where("node <> next"))
    places = graph.chain_places(links.select("program", "node", "next"), ["program"])
    # links of cycles stay jumps; the entry's run leads no cycle, since nothing else may lead to it
    kept_links = links.join(places.select("program", F.col("node").alias("next")), ["program", "next"], "left_semi")
    gone = kept_links.select("program", F.col("at").alias("pc"))
    order = runs.select("program", "block", "run").join(places.withColumnRenamed("node", "run"), ["program", "run"], "left")
    order = order.select("program", "block", "run", F.coalesce("head", "run").alias("head"), F.coalesce("place", F.lit(0)).alias("place"))
    left = placed.join(gone, ["program", "pc"], "left_anti").join(order, ["program", "block"])
    w = Window.partitionBy("program").orderBy("head", "place", "block", "pc").rowsBetween(Window.unboundedPreceding, -1)
    moved = cut(left.select("program", F.coalesce(F.sum(B.width(F.col("insn.code"))).over(w), F.lit(0)).cast("int").alias("pc"), "insn", "high", F.col("pc").alias("old_pc"), "block"))
    # a name leads to the first instruction that is left of the block, or of what follows it
    first = moved.groupBy("program", "block").agg(F.min("pc").alias("new"))
    follows = Window.partitionBy("program").orderBy(F.desc("head"), F.desc("place"), F.desc("block")).rowsBetween(Window.unboundedPreceding, 0)
    goes_on = order.join(first, ["program", "block"], "left").withColumn("new", F.last("new", ignorenulls=True).over(follows))
    starts = goes_on.join(ends.select("program", "block", "start"), ["program", "block"]).select("program", F.col("start").alias("_target"), "new")
    met = moved.withColumn("_target", _target(F.col("insn"), F.col("old_pc"))).join(starts, ["program", "_target"], "left")
    delta = F.col("new") - F.col("pc") - 1
    code = F.col("insn.code")
    in_imm = (B.is_jump(code) & (B.kind(code) == B.JMP32)) | B.is_pseudo_call(F.col("insn")) | B.loads_function(F.col("insn"))
    far = F.col("_target").isNotNull() & ~in_imm & ~delta.between(-(1 << 15), (1 << 15) - 1)
    insn = F.when(F.col("_target").isNull(), F.col("insn")).when(in_imm, F.col("insn").withField("imm", delta.cast("int"))).otherwise(F.col("insn").withField("off", F.when(~far, delta.cast("int"))))
    return met.select("program", "pc", insn.alias("insn"), "high", "old_pc", F.when(far, "too far").alias("problem"))

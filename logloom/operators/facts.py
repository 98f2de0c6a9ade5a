"""What is known about registers by reading instructions alone: constants, offsets into the frame, pointers to a packet and its end.

A straight run of blocks is a segment: a block goes on with what is known where the one before it is its only predecessor and falls
through to it, and starts anew (only r10 known) anywhere else. Inside a segment each definition of a register is a node; a copy, an
addition and the like hang on the definition that they read, so definitions form trees whose roots are constants, loads, the context
and the frame pointer. What a chain of such steps does to its root's value has a closed form, and closed forms compose; so all chains
are folded by pointer jumping: every round joins each node with the node that its chain has reached, and chains double in length.
A program of a million instructions in a row takes twenty rounds, and no task walks it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bytecode as B
from . import cfg
from .asof import latest
from .cfg import is_kinsn_call, is_sidecar
from .storage import kept

MIN32, MAX32, MIN64, MAX64 = -(1 << 31), (1 << 31) - 1, -(1 << 63), (1 << 63) - 1
WIDE = "decimal(38,0)"
CONTEXT, FRAME = 1, 10


# ---- steps and chains of them ----


def step(i: Column, high: Column) -> Column:
    """(kind, src, value) of what an instruction makes of its destination: const, copy, add, sub (64 bits, with an immediate), low (a copy
    of the low half), add32, load (of a word, at an offset), or unknown. Null where it defines nothing."""
    code, klass, op, imm = i["code"], B.kind(i["code"]), B.operation(i["code"]), i["imm"].cast("long")
    x = B.from_register(code)
    made = lambda kind, src=None, value=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None) if src is None else src).cast("int").alias("src"), (F.lit(None) if value is None else value).cast("long").alias("value"))
    low = F.pmod(imm, F.lit(1 << 32))
    signed = B.wide_value(i["imm"], high).cast(WIDE)
    signed = F.when(signed > MAX64, signed - F.lit(str(1 << 64)).cast(WIDE)).otherwise(signed)
    mov, add, sub = op == B.MOV, op == 0x00, op == 0x10
    wide = (
        F.when(mov & ~x, made("const", None, imm)).when(mov, made("copy", i["src"])).when(add & ~x, made("add", i["dst"], imm)).when(sub & ~x, made("sub", i["dst"], imm)).otherwise(made("unknown"))
    )
    half = F.when(mov & ~x, made("const", None, low)).when(mov, made("low", i["src"])).when(add & ~x, made("add32", i["dst"], imm)).when(sub & ~x, made("add32", i["dst"], -imm)).otherwise(made("unknown"))
    return (
        F.when(is_sidecar(i), None)
        .when(code == B.LDIMM64, made("const", None, signed.cast("long")))
        .when(klass == B.ALU64, wide)
        .when(klass == B.ALU, half)
        .when(klass == B.LDX, F.when(code == B.LOAD_WORD, made("load", i["src"], i["off"])).otherwise(made("unknown")))
        .when(klass == B.LD, made("unknown"))
    )


def chain(kind: Column, value: Column) -> Column:
    """One step as a chain. Fields: plain (copies only), subtracts; sum, least, most: what 64-bit additions add before any 32-bit step, with
    the bounds that it has on the way; moved, floor, ceiling: the same for an offset that stops at 32 bits; halved: 32-bit steps occur,
    after which the value is (root + wrapped) modulo 2^32, plus rest."""
    k = F.when(kind == "add", value).when(kind == "sub", -value).otherwise(F.lit(0)).cast("long")
    halved = kind.isin("low", "add32")
    zero = F.lit(0).cast("long")
    return F.struct(
        (kind == "copy").alias("plain"), (kind == "sub").alias("subtracts"), k.alias("sum"), F.least(k, zero).alias("least"), F.greatest(k, zero).alias("most"),
        k.alias("moved"), F.lit(MIN32).cast("long").alias("floor"), F.lit(MAX32).cast("long").alias("ceiling"), halved.alias("halved"), F.when(kind == "add32", value).otherwise(zero).cast("long").alias("wrapped"), zero.alias("rest"),
    )


def composed(first: Column, then: Column) -> Column:
    """The chain that takes one chain and then another. Copies leave everything as it is."""
    a, b = first, then
    clamp = lambda x: F.least(b["ceiling"], F.greatest(b["floor"], x))
    both = F.struct(
        F.lit(False).alias("plain"), (a["subtracts"] | b["subtracts"]).alias("subtracts"), F.when(a["halved"], a["sum"]).otherwise(a["sum"] + b["sum"]).alias("sum"),
        F.when(a["halved"], a["least"]).otherwise(F.least(a["least"], a["sum"] + b["least"])).alias("least"), F.when(a["halved"], a["most"]).otherwise(F.greatest(a["most"], a["sum"] + b["most"])).alias("most"),
        (a["moved"] + b["moved"]).alias("moved"), clamp(a["floor"] + b["moved"]).alias("floor"), clamp(a["ceiling"] + b["moved"]).alias("ceiling"), (a["halved"] | b["halved"]).alias("halved"),
        F.when(b["halved"], F.when(a["halved"], a["wrapped"] + a["rest"]).otherwise(a["sum"]) + b["wrapped"]).otherwise(a["wrapped"]).alias("wrapped"),
        F.when(b["halved"], b["rest"]).when(a["halved"], a["rest"] + b["sum"]).otherwise(F.lit(0)).cast("long").alias("rest"),
    )
    return F.when(a["plain"], b).when(b["plain"], a).otherwise(both)


def applied(root: Column, c: Column) -> Column:
    """The fact (kind, value, made_at) that a chain makes of its root's; null where nothing is known.

    A 64-bit sum must stay within 64 bits at each step, a frame offset within 32; a packet's offset stops there, and does not survive a
    subtraction. Half-width steps are followed for constants only."""
    kind, value = root["kind"], root["value"].cast(WIDE)
    halved = F.pmod(value + c["wrapped"], F.lit(str(1 << 32)).cast(WIDE)) + c["rest"]
    fits = lambda lo, hi: (value + c["least"] >= F.lit(str(lo)).cast(WIDE)) & (value + c["most"] <= F.lit(str(hi)).cast(WIDE))
    moved = F.least(c["ceiling"], F.greatest(c["floor"], root["value"] + c["moved"]))
    new = (
        F.when(kind == "const", F.when(fits(MIN64, MAX64), F.when(c["halved"], halved).otherwise(value + c["sum"])))
        .when((kind == "frame") & ~c["halved"], F.when(fits(MIN32, MAX32), value + c["sum"]))
        .when((kind == "packet") & ~c["halved"] & ~c["subtracts"], moved.cast(WIDE))
    ).cast("long")
    fact = F.struct(kind.alias("kind"), new.alias("value"), root["made_at"].alias("made_at"))
    return F.when(c.isNull() | c["plain"], root).when(new.isNotNull(), fact)


# ---- segments and definitions ----


def segments(blocks: DataFrame) -> DataFrame:
    """Adds segment to blocks, numbered from 0 in a program."""
    edges = cfg.successors(blocks)
    entered = edges.groupBy("program", F.col("dst").alias("block")).agg(F.countDistinct("src").alias("_n"), F.max("src").alias("_src"))
    w = Window.partitionBy("program").orderBy("block")
    met = blocks.join(entered, ["program", "block"], "left").withColumn("_before", F.lag("terminator").over(w))
    goes_on = F.coalesce((F.col("_n") == 1) & (F.col("_src") == F.col("block") - 1) & F.col("_before").isin("fallthrough", "branch"), F.lit(False))
    return met.withColumn("segment", F.sum((~goes_on).cast("int")).over(w) - F.lit(1)).drop("_n", "_src", "_before")


def with_segments(rows: DataFrame) -> DataFrame:
    """Adds segment to instructions (program, pc, insn, high), and how many calls that change everything stand before each in it."""
    found = kept(cfg.placed(rows))
    placed = found.drop("frame").join(segments(cfg.blocks_of(found)).select("program", "block", "segment"), ["program", "block"])
    w = Window.partitionBy("program", "segment").orderBy("pc").rowsBetween(Window.unboundedPreceding, -1)
    i = F.col("insn")
    calls = (B.is_call(i["code"]) & ~is_kinsn_call(i)).cast("int")
    return placed.withColumn("calls", F.coalesce(F.sum(calls).over(w), F.lit(0)))


def definitions(placed: DataFrame, kinsn_defs: DataFrame | None = None) -> DataFrame:
    """(program, segment, pc, reg, step, calls): what each instruction makes of each register that it defines.

    A call leaves r0 to r5 unknown; a call of a kernel instruction what its descriptor writes (program, pc, reg)."""
    i = F.col("insn")
    rows = placed.select("program", "segment", "pc", "insn", "calls", step(i, F.col("high")).alias("step"))
    plain = rows.where("step is not null").select("program", "segment", "pc", i["dst"].alias("reg"), "step", "calls")
    unknown = F.struct(F.lit("unknown").alias("kind"), F.lit(None).cast("int").alias("src"), F.lit(None).cast("long").alias("value"))
    called = rows.where(B.is_call(i["code"]) & ~is_kinsn_call(i)).select("program", "segment", "pc", F.explode(F.array(*map(F.lit, range(6)))).alias("reg"), unknown.alias("step"), "calls")
    out = plain.unionByName(called)
    if kinsn_defs is None:
        return out
    special = rows.where(is_kinsn_call(i)).select("program", "segment", "pc", "calls").join(kinsn_defs.select("program", "pc", F.col("reg").cast("int").alias("reg")), ["program", "pc"])
    return out.unionByName(special.select("program", "segment", "pc", "reg", unknown.alias("step"), "calls"))


def folded(links: DataFrame) -> DataFrame:
    """(program, pc, reg, root_pc, root_reg, chain): chains folded up to their roots, from (program, pc, reg, up_pc, up_reg, chain)."""
    moving, settled = links, []
    while True:
        whole = reduce(DataFrame.unionByName, [moving, *settled])
        up = whole.select("program", F.col("pc").alias("up_pc"), F.col("reg").alias("up_reg"), F.col("up_pc").alias("_pc"), F.col("up_reg").alias("_reg"), F.col("chain").alias("_chain"))
        met = moving.join(up, ["program", "up_pc", "up_reg"], "left")
        goes = F.col("_pc").isNotNull()
        met = met.select(
            "program", "pc", "reg", F.when(goes, F.col("_pc")).otherwise(F.col("up_pc")).alias("up_pc"), F.when(goes, F.col("_reg")).otherwise(F.col("up_reg")).alias("up_reg"),
            F.when(goes, composed(F.col("_chain"), F.col("chain"))).otherwise(F.col("chain")).alias("chain"), goes.alias("_went"),
        )
        met = kept(met)
        # chains at their roots are not written again; others still look them up
        settled.append(met.where("not _went").drop("_went"))
        moving = met.where("_went").drop("_went")
        if moving.isEmpty():
            return reduce(DataFrame.unionByName, settled).withColumnsRenamed({"up_pc": "root_pc", "up_reg": "root_reg"})


def register_facts(rows: DataFrame, points: DataFrame, types: DataFrame, kinsn_defs: DataFrame | None = None) -> DataFrame:
    """Adds to points (program, pc, reg) what is known about the register before the instruction: kind (const, context, frame, packet,
    packet_end), value (the constant, or the offset), made_at (the pc of the load that a packet's pointers go back to). Null if nothing is.

    rows: (program, pc, insn, high); types: (program, program_type), by which loads from the context are loads of the packet's bounds."""
    placed = kept(with_segments(rows))
    defs = kept(definitions(placed, kinsn_defs))
    key = ["program", "segment", "reg"]
    # what a segment starts with stands before its first instruction: a node of its own, at -1 - segment
    entries = placed.select("program", "segment").distinct().withColumn("reg", F.explode(F.when(F.col("segment") == 0, F.array(F.lit(CONTEXT), F.lit(FRAME))).otherwise(F.array(F.lit(FRAME))))).withColumn("node", (-1 - F.col("segment")).cast("int"))
    nodes = defs.select(*key, "pc", F.col("pc").alias("node")).unionByName(entries.select(*key, F.lit(-1).alias("pc"), "node"))
    derived = defs.where("step.src is not null").select("program", "segment", "pc", F.col("reg").alias("_reg"), "step", F.col("step.src").alias("reg"))
    links = latest(derived, nodes, key, "pc", F.col("node"), name="up_pc").where("up_pc is not null")
    links = links.select("program", "pc", F.col("_reg").alias("reg"), "up_pc", F.col("reg").alias("up_reg"), chain(F.when(F.col("step.kind") == "load", "copy").otherwise(F.col("step.kind")), F.col("step.value")).alias("chain"), F.col("step.kind").alias("_kind"))
    links = kept(links)
    loads = links.where("_kind = 'load'").select("program", "pc", F.col("up_pc").alias("node"), F.col("up_reg").alias("node_reg"))
    chains = folded(links.where("_kind <> 'load'").drop("_kind"))
    # loads from the context: by what their address goes back to
    here = chains.select("program", F.col("pc").alias("node"), F.col("reg").alias("node_reg"), "root_pc", "root_reg", "chain.plain")
    met = loads.join(here, ["program", "node", "node_reg"], "left")
    from_context = met.where((F.coalesce("root_pc", "node") == -1) & (F.coalesce("root_reg", "node_reg") == CONTEXT) & F.coalesce("plain", F.lit(True))).select("program", "pc")
    layout = types.select("program", B.packet_layout(F.lit("packet"), F.col("program_type")).alias("layout")).where("layout is not null")
    bounds = defs.where("step.kind = 'load'").join(from_context, ["program", "pc"]).join(layout, "program")
    bounds = bounds.select("program", "segment", "pc", "reg", "calls", F.when(F.col("step.value") == F.col("layout.data"), "packet").when(F.col("step.value") == F.col("layout.data_end"), "packet_end").alias("kind")).where("kind is not null")
    i = F.col("insn")
    resets = placed.where(B.is_call(i["code"]) & ~is_kinsn_call(i)).select("program", "segment", "pc", F.lit(None).cast("int").alias("data"))
    marks = bounds.where("kind = 'packet'").select("program", "segment", "pc", F.col("pc").alias("data")).unionByName(resets)
    bounds = latest(bounds, marks, ["program", "segment"], "pc", F.col("data"), name="_data").withColumn("made_at", F.when(F.col("kind") == "packet_end", F.coalesce("_data", "pc")).otherwise(F.col("pc")))
    # roots with what they are, and how many calls stand before them
    fact = lambda kind, value, at: F.struct(kind.alias("kind"), value.cast("long").alias("value"), at.cast("int").alias("made_at"))
    none = F.lit(None)
    roots = (
        defs.where("step.kind = 'const'").select("program", F.col("pc").alias("root_pc"), F.col("reg").alias("root_reg"), fact(F.lit("const"), F.col("step.value"), none).alias("root"), "calls")
        .unionByName(bounds.select("program", F.col("pc").alias("root_pc"), F.col("reg").alias("root_reg"), fact(F.col("kind"), F.when(F.col("kind") == "packet", 0), F.col("made_at")).alias("root"), "calls"))
        .unionByName(entries.select("program", F.col("node").alias("root_pc"), F.col("reg").alias("root_reg"), fact(F.when(F.col("reg") == CONTEXT, "context").otherwise("frame"), F.when(F.col("reg") == FRAME, 0), none).alias("root"), F.lit(0).alias("calls")))
    )
    # what a point sees: the latest definition in its segment, the root that this goes back to, and what the chain makes of it
    asked = points.join(placed.select("program", "pc", "segment", F.col("calls").alias("_calls")), ["program", "pc"], "left")
    seen = latest(asked, nodes, key, "pc", F.col("node"), name="_node")
    ends = chains.select("program", F.col("pc").alias("_node"), "reg", "root_pc", "root_reg", "chain")
    seen = seen.join(ends, ["program", "_node", "reg"], "left").withColumn("root_pc", F.coalesce("root_pc", "_node")).withColumn("root_reg", F.coalesce("root_reg", "reg"))
    seen = seen.join(roots, ["program", "root_pc", "root_reg"], "left").withColumn("_fact", applied(F.col("root"), F.col("chain")))
    # a call makes pointers into the packet void; the load itself comes after the calls that are counted before it
    void = F.col("_fact.kind").isin("packet", "packet_end") & (F.col("_calls") > F.col("calls"))
    out = lambda name: F.when(~void, F.col(f"_fact.{name}")).alias(name)
    return seen.select(*points.columns, out("kind"), out("value"), out("made_at"))

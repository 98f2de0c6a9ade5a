"""Programs as they are loaded: an entry section with all functions that it calls laid out behind it, and its calls re-based.

Objects are tables: code (object, section, slot, insn), one row for each slot of eight bytes; sections (object, section, name); symbols
(object, symbol, section, kind, offset, size) and relocations (object, section, offset, kind, size, target_symbol, target_section), with
offsets and sizes in bytes. Reading them out of files is left to a loader.

A call names a place; the function there is the one that starts last among those that cover it. The call tree of an entry is expanded
round by round. A function is laid out where a walk that follows every call at once would meet it first, and that is the order of the
smallest paths of call places: so each round keeps the smallest path to each function, and places are sums over that order. No entry's
code is in one piece anywhere. Calls and what is reached are dealt out by object once, and rounds shuffle nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bytecode as B
from .storage import cut, dealt, in_place, kept

WORD = 8
# The section of shared functions, and sections that hold no programs.
SHARED = ".text"
NO_PROGRAMS = ("license", "maps", "version")


def entry_sections(sections: DataFrame, code: DataFrame) -> DataFrame:
    """(object, section): sections that hold a program of their own: not hidden ones, nor those of licences, maps and versions."""
    named = sections.where(~F.col("name").startswith(".") & ~F.col("name").isin(*NO_PROGRAMS) & ~F.col("name").startswith("license"))
    return named.select("object", "section").join(code.select("object", "section").distinct(), ["object", "section"], "left_semi")


def functions(sections: DataFrame, symbols: DataFrame, code: DataFrame) -> DataFrame:
    """(object, section, start, count) in slots: the text symbols of shared sections that lie inside them. One whose offset or size is no
    whole number of slots makes its object unusable (`misplaced_symbols`)."""
    sizes = code.groupBy("object", "section").agg((F.max("slot") + 1).alias("slots"))
    shared = sections.where(F.col("name") == SHARED).select("object", "section").join(sizes, ["object", "section"])
    found = symbols.where("kind = 'text' and size > 0").join(shared, ["object", "section"])
    found = found.select("object", "section", (F.col("offset") / WORD).cast("long").alias("start"), (F.col("size") / WORD).cast("long").alias("count"), "slots").where("start + count <= slots")
    return found.groupBy("object", "section", "start").agg(F.max("count").alias("count"))


def misplaced_symbols(sections: DataFrame, symbols: DataFrame) -> DataFrame:
    """(object, symbol): text symbols of shared sections that do not start or end at a slot."""
    shared = sections.where(F.col("name") == SHARED).select("object", "section")
    return symbols.where("kind = 'text' and size > 0").join(shared, ["object", "section"]).where((F.col("offset") % WORD != 0) | (F.col("size") % WORD != 0)).select("object", "symbol")


def call_relocations(code: DataFrame, symbols: DataFrame, relocations: DataFrame) -> DataFrame:
    """(object, section, slot, to_section, base): where a relocation moves a call to: a symbol's section and slot, or a section's start.
    Only absolute ones of 32 bits that stand at a call count; of several at a slot the one with the largest target."""
    held = code.select("object", "section").distinct()
    at = relocations.where(f"kind = 'absolute' and size = 32 and offset % {WORD} = 0").withColumn("slot", (F.col("offset") / WORD).cast("long"))
    calls = code.where(B.is_pseudo_call(F.col("insn"))).select("object", "section", F.col("slot").cast("long").alias("slot"))
    named = symbols.select("object", F.col("symbol").alias("target_symbol"), F.col("section").alias("_section"), F.floor(F.col("offset") / WORD).alias("_base"))
    met = at.join(calls, ["object", "section", "slot"]).join(named, ["object", "target_symbol"], "left")
    met = met.select("object", "section", "slot", F.coalesce("_section", "target_section").alias("to_section"), F.coalesce("_base", F.lit(0)).alias("base")).where("to_section is not null")
    kept = met.join(held.withColumnRenamed("section", "to_section"), ["object", "to_section"], "left_semi")
    return kept.groupBy("object", "section", "slot").agg(F.max(F.struct("to_section", "base")).alias("t")).select("object", "section", "slot", "t.*")


def call_targets(code: DataFrame, relocated: DataFrame) -> DataFrame:
    """(object, section, slot, insn, to_section, to_slot): the place that each call of a function of the program names."""
    calls = code.where(B.is_pseudo_call(F.col("insn"))).select("object", "section", F.col("slot").cast("long").alias("slot"), "insn")
    met = calls.join(relocated, ["object", "section", "slot"], "left")
    return met.select("object", "section", "slot", "insn", F.coalesce("to_section", "section").alias("to_section"), (F.coalesce("base", "slot") + F.col("insn.imm").cast("long") + 1).alias("to_slot"))


def covering(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """Adds to points (object, to_section, to_slot) start and count of the interval (object, section, start, count) that starts last among
    those that hold the slot; null if none does. Intervals may nest: each is spread over its slots, which are no more than the code's
    for each level of nesting."""
    spread = intervals.withColumnRenamed("section", "to_section").withColumn("to_slot", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("count") - 1)))
    last = spread.groupBy("object", "to_section", "to_slot").agg(F.max(F.struct("start", "count")).alias("_f"))
    return points.join(last, ["object", "to_section", "to_slot"], "left").select(*points.columns, "_f.start", "_f.count")


def call_edges(code: DataFrame, sections: DataFrame, symbols: DataFrame, relocations: DataFrame) -> DataFrame:
    """(object, section, slot, insn, to_section, start, count): calls and the functions that they reach; start is null where there is none."""
    return covering(call_targets(code, call_relocations(code, symbols, relocations)), functions(sections, symbols, code)).select("object", "section", "slot", "insn", "to_section", "start", "count")


def _shortest(reached: DataFrame, piece: list[str]) -> DataFrame:
    """Of each piece the row with the smallest path."""
    rest = [F.min_by("seen", "path").alias("seen")] if "seen" in reached.columns else []
    return reached.groupBy(*piece).agg(F.first("count").alias("count"), F.min("path").alias("path"), *rest)


def layouts(entries: DataFrame, edges: DataFrame, code: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(object, entry, section, start, count, loaded_at) of the pieces of each entry section, and (object, entry, problem) of entries that
    cannot be laid out: a call without a function, or recursion. Those stay as they are. Every round reads `edges`, dealt out by object in
    a session that works `in_place`."""
    sizes = code.groupBy("object", "section").agg((F.max("slot") + 1).cast("long").alias("count"))
    first = entries.join(sizes, ["object", "section"]).select("object", F.col("section").alias("entry"), "section", F.lit(0).cast("long").alias("start"), "count", F.array().cast("array<bigint>").alias("path"), F.array(F.struct("section", F.lit(0).cast("long").alias("start"))).alias("seen"))
    edges = edges.select("object", "section", "slot", "to_section", F.col("start").alias("to_start"), F.col("count").alias("to_count"))
    new = dealt(first, "object", edges.sparkSession)
    piece, parts = ["object", "entry", "section", "start"], [new]
    problems = None
    while True:
        calls = new.join(edges, ["object", "section"]).where("slot >= start and slot < start + count")
        callee = F.struct(F.col("to_section").alias("section"), F.col("to_start").alias("start"))
        problem = F.when(F.col("to_start").isNull(), "no function").when(F.array_contains("seen", callee), "recursion")
        calls = cut(calls.select("object", "entry", problem.alias("problem"), F.col("to_section").alias("section"), F.col("to_start").alias("start"), F.col("to_count").alias("count"), F.concat("path", F.array(F.col("slot") - F.col("start"))).alias("path"), F.concat("seen", F.array(callee)).alias("seen")))
        bad = calls.where("problem is not null").select("object", "entry", "problem").distinct()
        problems = bad if problems is None else problems.unionByName(bad)
        best = _shortest(calls.where("problem is null"), piece)
        old = reduce(DataFrame.unionByName, parts).select(*(F.col(c).alias(f"_{c}") for c in piece), F.col("path").alias("_path"))
        known = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"_{c}") for c in piece)) & (F.col("_path") <= F.col("path"))
        new = cut(best.join(old, known, "left_anti").select(*new.columns))  # a smaller path opens the function anew
        if new.isEmpty():
            break
        parts.append(new)  # what is known is read again, and never written again
    problems = cut(problems.distinct())
    w = Window.partitionBy("object", "entry").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    known = _shortest(reduce(DataFrame.unionByName, (part.select(*piece, "count", "path") for part in parts)), piece)
    good = known.join(problems, ["object", "entry"], "left_anti")
    return good.select("object", "entry", "section", "start", "count", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("loaded_at")), problems


def loaded(code: DataFrame, sections: DataFrame, symbols: DataFrame, relocations: DataFrame) -> DataFrame:
    """(object, entry, slot, insn, problem): the slots of each program as they are loaded, its calls pointing to the functions behind it.
    An entry with a problem, or of an object with misplaced symbols, keeps its section's slots."""
    code = code.withColumn("slot", F.col("slot").cast("long"))
    edges = dealt(call_edges(code, sections, symbols, relocations), "object", in_place(code.sparkSession))
    entries = entry_sections(sections, code)
    spoilt = misplaced_symbols(sections, symbols).select("object").distinct()
    pieces, problems = layouts(entries.join(spoilt, "object", "left_anti"), edges, code)
    pieces = cut(pieces)
    # only calls look for what they call
    is_call = F.coalesce(B.is_pseudo_call(F.col("insn")), F.lit(False))
    at = F.col("loaded_at") + F.col("slot") - F.col("start")
    plain = pieces.join(code.where(~is_call), ["object", "section"]).where("slot >= start and slot < start + count").select("object", "entry", at.alias("slot"), "insn")
    target = edges.select("object", "section", "slot", "insn", F.col("to_section").alias("_section"), F.col("start").alias("_start"))
    calls = pieces.join(target, ["object", "section"]).where("slot >= start and slot < start + count").select("object", "entry", at.alias("slot"), "insn", "_section", "_start")
    where = pieces.select("object", "entry", F.col("section").alias("_section"), F.col("start").alias("_start"), F.col("loaded_at").alias("_to"))
    moved = F.col("insn").withField("imm", (F.col("_to") - F.col("slot") - 1).cast("int"))
    calls = calls.join(where, ["object", "entry", "_section", "_start"], "left").select("object", "entry", "slot", moved.alias("insn"))
    good = plain.unionByName(calls).withColumn("problem", F.lit(None).cast("string"))
    spoilt = kept(entries.join(spoilt, "object", "left_semi").select("object", F.col("section").alias("entry"), F.lit("misplaced symbol").alias("problem")), edges.sparkSession)
    why = problems.groupBy("object", "entry").agg(F.min("problem").alias("problem")).unionByName(spoilt)
    if why.isEmpty():  # else all code is shuffled once more
        return good
    bad = why.join(code.withColumnRenamed("section", "entry"), ["object", "entry"]).select("object", "entry", "slot", "insn", "problem")
    return good.unionByName(bad)

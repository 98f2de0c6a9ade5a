"""Checks of the logs of accepted programs: which ring buffer records were written and submitted, which registers pointed where.

Logs are (log_id, line_no, line). What a register was at a line is the last thing a line above it said since the path started anew
(an empty line, the entry, or a `from` line): one window for each register, no state machine in Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.instructions import _found

ENTRY = "0: R1="
STORE32 = r"\*\(u32 \*\)\(r(\d+)\s*([+-])\s*(\d+)\)\s*=\s*r(\d+)"
SUBMIT, DISCARD = "call bpf_ringbuf_submit#132", "call bpf_ringbuf_discard#133"


# ---- what a line says of registers ----


def ringbuf_refs(line: Column, register: str | Column, size: int = 4) -> Column:
    """References of ring buffer records of this size that the register holds by this line."""
    name = F.lit(register) if isinstance(register, str) else register
    found = F.regexp_extract_all(line, F.concat(F.lit(r"\bR"), name, F.lit(rf"(?:_w)?=ringbuf_mem\(ref_obj_id=(\d+),sz={size}\)")), F.lit(1))
    return F.array_distinct(found)


def _updates(line: Column) -> Column:
    """(register, value) of each `Rn=value`, in order."""
    pattern = r"\bR(\d+)(?:_w)?=([^\s;]+)"
    names, values = (F.regexp_extract_all(line, F.lit(pattern), F.lit(k)) for k in (1, 2))
    return F.zip_with(names, values, lambda n, v: F.struct(n.alias("register"), v.alias("value")))


def map_value_updates(line: Column) -> Column:
    """(register, is_map_value) of each register that the line names."""
    return F.transform(_updates(line), lambda u: F.struct(u["register"].alias("register"), u["value"].startswith("map_value(").alias("is_map_value")))


def packet_updates(line: Column) -> Column:
    """(register, state) of each register that the line names: the text of a packet pointer's state, else null."""
    return F.transform(_updates(line), lambda u: F.struct(u["register"].alias("register"), F.when(u["value"].startswith("pkt("), u["value"]).alias("state")))


def packet_offset(state: Column) -> Column:
    """The constant offset of a packet pointer's state; 0 if it names none."""
    return F.when(state.startswith("pkt("), F.coalesce(_found(state, r"\boff=(-?\d+)", 1).try_cast("int"), F.lit(0)))


def has_variable_offset(state: Column) -> Column:
    return state.contains("var_off=") | state.rlike(r"\bumax=[1-9]\d*")


def scalar_values(line: Column, register: str | Column) -> Column:
    """The numbers that the register is said to be."""
    name = F.lit(register) if isinstance(register, str) else register
    texts = F.regexp_extract_all(line, F.concat(F.lit(r"\bR"), name, F.lit(r"(?:_w)?=(-?(?:0x[0-9a-fA-F]+|\d+))\b")), F.lit(1))
    number = lambda t: F.when(t.contains("0x"), F.when(t.startswith("-"), -1).otherwise(1) * F.conv(F.regexp_replace(t, "^-?0x", ""), 16, 10).try_cast("long")).otherwise(t.try_cast("long"))
    return F.transform(texts, number)


def normalized_output(text: Column, source: Column, work_dir: Column, obj: Column, pin: Column) -> Column:
    """A loader's output without what differs from run to run: paths, kernel addresses, file descriptors, times."""
    out = text
    for old, new in ((source, "buggy.bpf.c"), (work_dir, "<work-dir>"), (obj, "<object>"), (pin, "<bpffs-pin>")):
        out = F.replace(out, old, F.lit(new))
    for pattern, new in ((r"/tmp/[a-z]+-bench-[A-Za-z0-9_.-]+", "<work-dir>"), ("0xffff[0-9a-fA-F]+", "0xffff000000000000"), (r"fd=\d+", "fd=0"), (r"verification time \d+ usec", "verification time 0 usec")):
        out = F.regexp_replace(out, pattern, new)
    return out


# ---- paths ----


def paths(all_lines: DataFrame, resets_at_from: bool = True, entry_by_from: bool = False) -> DataFrame:
    """Adds path (it grows where what is known is forgotten) and inside (from the first annotated entry on)."""
    w = Window.partitionBy("log_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    line = F.col("line")
    entry = line.startswith(ENTRY)
    came = line.startswith("from ")
    anew = (F.trim("line") == "") | entry | (came if resets_at_from else F.lit(False))
    begins = entry | came if entry_by_from else entry
    return all_lines.withColumn("path", F.sum(anew.cast("int")).over(w)).withColumn("inside", F.max(begins.cast("int")).over(w) == 1).withColumn("head", entry | came)


def known(rows: DataFrame, said: Column, name: str, inclusive: bool = True) -> DataFrame:
    """Adds what was said last on the same path: at the line itself too, or only above it."""
    w = Window.partitionBy("log_id", "path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return rows.withColumn(name, F.last(said, ignorenulls=True).over(w))


# ---- checks; each gives a row for each log that has a trace or a hit ----


def written_refs(all_lines: DataFrame, values: tuple | None = None, offset: int = 0, size: int = 4) -> DataFrame:
    """(log_id, line_no, path, refs): stores of 32 bits to ring buffer records, at this offset, of one of the values if given."""
    rows = paths(all_lines).where("inside and not head")
    at = F.concat(_found(F.col("line"), STORE32, 2), _found(F.col("line"), STORE32, 3)).try_cast("int")
    base, source = _found(F.col("line"), STORE32, 1), _found(F.col("line"), STORE32, 4)
    rows = rows.where(F.col("line").rlike(STORE32)).where(at == offset)
    if values is not None:
        rows = rows.where(F.arrays_overlap(scalar_values(F.col("line"), source), F.array(*(F.lit(v).cast("long") for v in values))))
    return rows.select("log_id", "line_no", "path", ringbuf_refs(F.col("line"), base, size).alias("refs")).where("size(refs) > 0")


def refs_with_value(all_lines: DataFrame, value: int, **more) -> DataFrame:
    """(log_id, refs): records into which the value was stored, on any path."""
    return written_refs(all_lines, (value,), **more).groupBy("log_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("refs"))


def _passed(all_lines: DataFrame, call: str, size: int = 4) -> DataFrame:
    """(log_id, line_no, path, refs): calls with the records that r1 held there."""
    said = F.when(F.col("line").rlike(r"\bR1(?:_w)?="), ringbuf_refs(F.col("line"), "1", size))
    rows = known(paths(all_lines), said, "refs").where("inside and not head").where(F.col("line").contains(call))
    return rows.select("log_id", "line_no", "path", F.coalesce("refs", F.array().cast("array<string>")).alias("refs"))


def submitted_refs(all_lines: DataFrame, call: str = SUBMIT, size: int = 4) -> DataFrame:
    """(log_id, refs): records that were passed to the call, on any path."""
    return _passed(all_lines, call, size).groupBy("log_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("refs")).where("size(refs) > 0")


def written_before(all_lines: DataFrame, call: str = SUBMIT, values: tuple | None = None, offset: int = 0, size: int = 4) -> DataFrame:
    """(log_id, passed): at every such call r1 holds a record that was written before on the same path."""
    calls = _passed(all_lines, call, size)
    stores = written_refs(all_lines, values, offset, size).select("log_id", "path", F.col("line_no").alias("stored"), F.explode("refs").alias("ref"))
    held = calls.select("log_id", "path", "line_no", F.explode("refs").alias("ref")).join(stores, ["log_id", "path", "ref"]).where("stored < line_no").select("log_id", "line_no").distinct().withColumn("ok", F.lit(True))
    return calls.join(held, ["log_id", "line_no"], "left").groupBy("log_id").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("passed"))


def submitted_with_value(all_lines: DataFrame, values: tuple, call: str = SUBMIT) -> DataFrame:
    """(log_id): logs that submit a record into which one of the values was stored."""
    stored = None
    for v in values:
        part = refs_with_value(all_lines, v)
        stored = part if stored is None else stored.unionByName(part)
    merged = stored.groupBy("log_id").agg(F.array_distinct(F.flatten(F.collect_list("refs"))).alias("stored"))
    return submitted_refs(all_lines, call).join(merged, "log_id").where(F.arrays_overlap("refs", "stored")).select("log_id")


def distinct_submissions(all_lines: DataFrame, least: int = 2) -> DataFrame:
    """(log_id): logs that submit at least so many different records."""
    return submitted_refs(all_lines).where(F.size("refs") >= least).select("log_id")


def _register_values(all_lines: DataFrame, register: str, entry_by_from: bool) -> DataFrame:
    values = scalar_values(F.col("line"), register)
    named = F.size(values) > 0 if entry_by_from else F.col("line").rlike(rf"\bR{register}(?:_w)?=")
    rows = paths(all_lines, entry_by_from=entry_by_from)
    # a `from` line is a new path; where the entry decides, what it says itself is not taken over
    said = F.when(named & (F.lit(entry_by_from) | ~F.col("line").startswith("from ")), values)
    return known(rows, said, "values").where("inside")


def calls_use_value(all_lines: DataFrame, call: str, register: str, value: int) -> DataFrame:
    """(log_id, passed): at every such call the register may be the value."""
    rows = _register_values(all_lines, register, False).where(F.col("line").contains(call) & ~F.col("head"))
    return rows.groupBy("log_id").agg(F.bool_and(F.coalesce(F.array_contains("values", F.lit(value).cast("long")), F.lit(False))).alias("passed"))


def reachable_with_value(all_lines: DataFrame, call: str, register: str, value: int) -> DataFrame:
    """(log_id): at some such call the register may be the value."""
    rows = _register_values(all_lines, register, True).where(F.col("line").contains(call) & ~F.col("head"))
    return rows.where(F.array_contains("values", F.lit(value).cast("long"))).select("log_id").distinct()


def adjusts_head_by(all_lines: DataFrame, delta: int = 14) -> DataFrame:
    return calls_use_value(all_lines, "call bpf_xdp_adjust_head#44", "2", delta)


def _pointers(all_lines: DataFrame, updates, inclusive: bool) -> DataFrame:
    """(log_id, line_no, line, register, state): for each line with a memory access the state of its base, as last said on the path."""
    rows = paths(all_lines, resets_at_from=False).where("inside")
    said = rows.select("log_id", "path", "line_no", F.posexplode(updates(F.col("line"))).alias("k", "u")).select("log_id", "path", "line_no", "k", "u.register", F.col("u").alias("state"))
    asks = rows.select("log_id", "path", "line_no", "line", _found(F.col("line"), r"\*\(u\d+ \*\)\(r(\d+)", 1).alias("register")).where("register is not null")
    w = Window.partitionBy("log_id", "path", "register").orderBy("line_no", "tag", "k").rowsBetween(Window.unboundedPreceding, 0)
    both = said.withColumn("tag", F.lit(0 if inclusive else 2)).withColumn("line", F.lit(None).cast("string")).unionByName(asks.withColumn("tag", F.lit(1)).withColumn("k", F.lit(0)).withColumn("state", F.lit(None).cast(said.schema["state"].dataType)))
    return both.withColumn("state", F.last("state", ignorenulls=True).over(w)).where("tag = 1")


def loads_map_value(all_lines: DataFrame, offset: int) -> DataFrame:
    """(log_id): logs that load 32 bits at this offset of a map's value."""
    rows = _pointers(all_lines, map_value_updates, False)
    return rows.where(F.col("line").rlike(rf"=\s*\*\(u32 \*\)\(r\d+\s*\+\s*{offset}\)") & F.col("state.is_map_value")).select("log_id").distinct()


def stores_map_value(all_lines: DataFrame, offset: int) -> DataFrame:
    """(log_id): logs that store 32 bits at this offset of a map's value; what the store's own line says of its base counts too."""
    wanted = F.col("line").rlike(rf"\*\(u32 \*\)\(r\d+\s*\+\s*{offset}\)\s*=\s*r\d+") & F.col("state.is_map_value")
    hits = (_pointers(all_lines, map_value_updates, inclusive).where(wanted).select("log_id") for inclusive in (False, True))
    return next(hits).unionByName(next(hits)).distinct()


def stores_packet_after(all_lines: DataFrame, call: str, width: str, offset: int, values: tuple | None = None) -> DataFrame:
    """(log_id): logs that, behind the call, store to this offset of the packet (one of the values, if given). The call voids pointers."""
    w = Window.partitionBy("log_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    called = F.col("line").contains(call)
    rows = all_lines.withColumn("calls", F.sum(called.cast("int")).over(w)).withColumn("line", F.when(called, F.lit("")).otherwise(F.col("line")))
    after = rows.where("calls > 0").unionByName(all_lines.where(F.col("line").startswith(ENTRY)).groupBy("log_id").agg(F.min("line_no").alias("line_no"), F.lit(ENTRY).alias("line")).withColumn("calls", F.lit(0)))
    met = _pointers(after.select("log_id", "line_no", "line"), packet_updates, True)
    store = rf"\*\({width} \*\)\(r(\d+)\s*([+-])\s*(\d+)\)\s*=\s*r(\d+)"
    at = packet_offset(F.col("state.state")) + F.concat(_found(F.col("line"), store, 2), _found(F.col("line"), store, 3)).try_cast("int")
    hits = met.where(F.col("line").rlike(store) & (at == offset))
    if values is not None:
        hits = hits.where(F.arrays_overlap(scalar_values(F.col("line"), _found(F.col("line"), store, 4)), F.array(*(F.lit(v).cast("long") for v in values))))
    return hits.select("log_id").distinct()


def stores_proto_after_change(all_lines: DataFrame) -> DataFrame:
    return stores_packet_after(all_lines, "call bpf_skb_change_proto#31", "u16", 12, (8,))


def loads_behind_variable_header(all_lines: DataFrame) -> DataFrame:
    """(log_id): logs that scale a header length by four and later load 16 bits at offset 2 of a packet pointer that varies."""
    shifts = all_lines.where(F.col("line").rlike(r"\br\d+\s*<<=\s*2\b")).groupBy("log_id").agg(F.min("line_no").alias("shifted"))
    rows = _pointers(all_lines, packet_updates, False).join(shifts, "log_id").where("line_no >= shifted")
    return rows.where(F.col("line").rlike(r"=\s*\*\(u16 \*\)\(r\d+\s*\+\s*2\)") & has_variable_offset(F.col("state.state"))).select("log_id").distinct()


def checks(logs: DataFrame, substrings: tuple, predicates: dict[str, DataFrame], kind: str = "predicate") -> DataFrame:
    """(log_id, kind, name, passed): for each log (log_id, text) whether it contains each text, and whether it is among each check's logs
    (log_id, and passed where the check has it)."""
    out = logs.select("log_id", F.explode(F.array(*(F.struct(F.lit("substring").alias("kind"), F.lit(s).alias("name"), F.col("text").contains(s).alias("passed")) for s in substrings))).alias("c")).select("log_id", "c.*") if substrings else None
    for name, hits in predicates.items():
        held = hits.where("passed") if "passed" in hits.columns else hits
        part = logs.select("log_id").join(held.select("log_id").distinct().withColumn("passed", F.lit(True)), "log_id", "left").select("log_id", F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.coalesce("passed", F.lit(False)).alias("passed"))
        out = part if out is None else out.unionByName(part)
    return out

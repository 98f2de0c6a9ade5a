"""From whole logs to lines, regions, fragments and terminal errors. Logs are (log_id, text); one log is an ordered group of rows.

All windows partition by log_id, so work spreads over logs, and none of them needs a log in one piece of memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import instructions as I
from ..functions import lines as L
from ..functions import messages as M


def _w(*order) -> Window:
    return Window.partitionBy("log_id").orderBy(*order)


def lines(logs: DataFrame, normalize: bool = True) -> DataFrame:
    """(log_id, line_no from 1, line): normalised lines without control lines, or all as they are."""
    # a text that ends with a newline has no last empty line
    raw = logs.select("log_id", F.posexplode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("at", "raw"))
    if not normalize:
        return raw.select("log_id", (F.col("at") + 1).alias("line_no"), F.regexp_replace("raw", r"\r$", "").alias("line"))
    kept = raw.select("log_id", "at", L.normalized(F.col("raw")).alias("line")).where(~L.is_control(F.col("line")))
    return kept.select("log_id", F.row_number().over(_w("at")).alias("line_no"), "line")


def region(all_lines: DataFrame) -> DataFrame:
    """The part of each log that describes the rejection.

    The last marked block that reports an error, else the last marked block; without marks the lines from the first that can
    start a region to the last error. A log without any of these keeps all its lines. Lines are numbered anew.
    """
    trimmed = F.trim("line")
    at = F.col("line_no")
    # narrow rows are sorted, in a stage of their own; what windows ask of a line is told behind that
    ordered = all_lines.repartition("log_id").sortWithinPartitions("log_id", "line_no")
    marked = ordered.withColumn("begin", F.col("line").contains(L.BEGIN_MARK)).withColumn("end", F.col("line").contains(L.END_MARK)).withColumn("error", L.is_error(trimmed)).withColumn("start", L.is_region_start(trimmed))
    before, whole = _w("line_no").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("log_id")
    # a block is named by the end mark before it, and is open behind its first begin mark; all windows read one order of the lines
    ended = F.coalesce(F.max(F.when(F.col("end"), at)).over(before), F.lit(-1))
    blocks = marked.withColumn("block", ended).withColumn("begun", F.max(F.when(F.col("begin"), at)).over(before))
    blocks = blocks.withColumn("inside", F.coalesce((F.col("begun") > F.col("block")) & ~F.col("end"), F.lit(False)))
    best = F.max(F.when(F.col("inside") & F.col("error"), F.col("block"))).over(whole)
    last = F.max(F.when(F.col("inside"), F.col("block"))).over(whole)
    last_error = F.max(F.when(F.col("error"), at)).over(whole)
    # the first start is behind the last error, or none is before it
    first = F.min(F.when(F.col("start"), at)).over(whole)
    chosen = blocks.withColumn("best", best).withColumn("last", last).withColumn("last_error", last_error).withColumn("first", first)
    plain = F.when(F.col("first") <= F.col("last_error"), at.between(F.col("first"), F.col("last_error"))).otherwise(F.lit(True))
    keep = F.when(F.col("last").isNotNull(), F.col("inside") & (F.col("block") == F.coalesce("best", "last"))).otherwise(plain)
    return chosen.where(keep).select("log_id", F.row_number().over(_w("line_no")).alias("line_no"), "line")


def fragments(all_lines: DataFrame) -> DataFrame:
    """Adds fragment_start: the line behind the last boundary before each line, or 1."""
    before = _w("line_no").rowsBetween(Window.unboundedPreceding, -1)
    boundary = F.when(L.is_boundary(F.trim("line")), F.col("line_no") + 1)
    return all_lines.withColumn("fragment_start", F.coalesce(F.last(boundary, ignorenulls=True).over(before), F.lit(1)))


def _register_detail(line: Column) -> Column:
    return line.rlike(r"^r\d") & line.rlike("value is outside|offset is outside|min value is negative|max value is outside|min value is outside")


def continues(first: Column, previous: Column) -> Column:
    """Whether a line that stands before `first` belongs to the same message, if it reports an error. Both trimmed."""
    a, b = L.ascii_lower(first), L.ascii_lower(previous)
    sleepable = (a.contains("non-sleepable bpf program context") & b.contains("rcu/irq/preempt-disabled")) | (a.contains("rcu/irq/preempt-disabled") & b.contains("may sleep") & b.contains("non-sleepable context"))
    detail = _register_detail(a) & b.rlike("invalid access|unbounded memory access|makes pkt pointer|out of bounds|outside of")
    pair = a.contains("memory, len pair leads to invalid memory access") & ((b.contains("type=") & b.contains("expected=")) | b.contains("invalid read from stack"))
    subprogram = a.contains("caller passes invalid args into func") & ((b.contains("reference type('unknown") & b.contains("size cannot be determined")) | (b.startswith("arg#") & b.contains("expects")))
    return sleepable | detail | pair | subprogram


def terminals(all_lines: DataFrame) -> DataFrame:
    """(log_id, line_no, message, pc, call_target, source) of each log with an error: the last one, with the lines before it that
    belong to the same message. pc, call and source are the nearest ones above it in its fragment."""
    w, whole, at = _w("line_no"), Window.partitionBy("log_id"), F.col("line_no")
    rows = all_lines.withColumn("line", F.trim("line")).withColumn("error", L.is_error(F.col("line")))
    rows = rows.withColumn("next", F.lead("line").over(w)).withColumn("last_error", F.max(F.when(F.col("error"), at)).over(whole)).where(at <= F.col("last_error"))
    # a chain upwards from the last error, up to the first line that does not continue
    alone = (at < F.col("last_error")) & ~F.coalesce(F.when(F.col("error"), continues(F.col("next"), F.col("line"))), F.lit(False))
    rows = rows.withColumn("alone", F.max(F.when(alone, at)).over(whole))
    part = at > F.coalesce("alone", F.lit(-1))
    tail = I.tail(F.col("line"))
    # what lies above the message, as long as no boundary lies between
    edge = F.max(F.when(~part & L.is_boundary(F.col("line"), F.col("error")), at)).over(whole)
    rows = rows.withColumn("edge", F.coalesce(edge, F.lit(0))).withColumn("above", ~part & (at > F.col("edge")))
    nearest = lambda c: F.max_by(F.when(F.col("above"), c), F.when(F.col("above") & c.isNotNull(), F.col("line_no")))
    message = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(part, F.struct("line_no", "line")))), lambda x: x["line"]), "; ")
    found = rows.groupBy("log_id").agg(F.min(F.when(part, F.col("line_no"))).alias("line_no"), message.alias("message"), nearest(I.pc(F.col("line"))).alias("above_pc"), nearest(I.call_target(tail)).alias("call_target"), nearest(L.source_comment(F.col("line"))).alias("source"))
    return found.select("log_id", "line_no", "message", F.coalesce(M.explicit_pc(F.col("message")), "above_pc").alias("pc"), "call_target", "source")


def instructions(all_lines: DataFrame) -> DataFrame:
    """(log_id, line_no, pc, tail) of the lines that are instructions."""
    return all_lines.where(I.is_instruction(F.col("line"))).select("log_id", "line_no", I.pc(F.col("line")).alias("pc"), I.tail(F.col("line")).alias("tail"))


def source_events(all_lines: DataFrame) -> DataFrame:
    """(log_id, line_no, pc, source): source comments, with the first pc on the four lines behind each."""
    w = _w("line_no")
    ahead = F.coalesce(*(F.lead(I.pc_prefix(F.col("line")), k).over(w) for k in range(1, 5)))
    return all_lines.withColumn("pc", ahead).withColumn("source", L.source_comment(F.trim("line"))).where("source is not null").select("log_id", "line_no", "pc", "source")

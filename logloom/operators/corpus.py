"""Checks of a corpus of labelled cases against its logs: a second, independent reading of logs, and the pcs of quoted lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.instructions import _found
from ..functions.lines import ascii_lower

INSTRUCTION = r"^\s*(\d+):\s*(?:[.0-9A-Za-z]+\s+)?\([0-9a-fA-F]{2,3}\)"
PROCESSED = r"(?i)\bprocessed\s+\d+\s+insns\b"
COMMENT = r"^\s*;\s*(.*?)(?:\s+@\s+[^@]+:\d+)?\s*$"
# What a line may not start with, and words one of which it must have, to end a log.
NO_ERRORS = ("libbpf:", "error:", "failed to", "make:", "clang", "ld.lld")
ERROR_WORDS = (
    "invalid", "unbounded", "not allowed", "prohibited", "permission", "misaligned", "unreleased", "too large", "possibly null", "null pointer", "out of bounds", "min value is negative", "reference leak", "unbounded memory access",
    "has no", "has to", "only read from", "does not allow", "does not support", "expected", "must", "may", "arg#", "access beyond", "dereference", "cannot", "missing btf func_info", "not an exit or jmp", "not pointing to valid",
    "makes pkt pointer", "!read_ok", "infinite loop", "math between", "type=", "verifier log", "unknown opcode", "should have been",
)
LOG_QUALITY = ("empty", "no_terminal_error", "message_only", "trace_rich")
LEGACY_SOURCES = ("stackoverflow", "github_issue", "github_commit")


def ends_log(line: Column) -> Column:
    """Whether a line looks like the error at a log's end."""
    t, low = F.trim(line), ascii_lower(F.trim(line))
    starts = reduce(lambda a, b: a | b, (low.startswith(s) for s in NO_ERRORS))
    says = reduce(lambda a, b: a | b, (low.contains(w) for w in ERROR_WORDS))
    return (t != "") & ~t.rlike(INSTRUCTION) & ~t.rlike(PROCESSED) & ~t.startswith(";") & ~t.rlike(r"^R\d+(?:_w)?=") & ~starts & says


def parsed_logs(all_lines: DataFrame) -> DataFrame:
    """(log_id, terminal_line, terminal_error, rejected_pc, quality): the last error before the first count of instructions, or else the
    last of all; the last instruction before it, or for unknown opcodes the start of the last function."""
    marked = all_lines.withColumn("is_end", ends_log(F.col("line"))).withColumn("processed", F.min(F.when(F.col("line").rlike(PROCESSED), F.col("line_no"))).over(Window.partitionBy("log_id")))
    log = Window.partitionBy("log_id")
    before = F.max(F.when(F.col("is_end") & (F.col("line_no") < F.col("processed")), F.col("line_no"))).over(log)
    marked = marked.withColumn("terminal_line", F.coalesce(before, F.max(F.when(F.col("is_end"), F.col("line_no"))).over(log)))
    limit = F.coalesce("terminal_line", "processed")
    above = limit.isNull() | (F.col("line_no") < limit)
    pc, start = _found(F.col("line"), INSTRUCTION, 1).try_cast("int"), _found(F.col("line"), r"^\s*func#\d+ @(\d+)", 1).try_cast("int")
    out = marked.groupBy("log_id").agg(
        F.first("terminal_line").alias("terminal_line"), F.trim(F.regexp_replace(F.trim(F.max(F.when(F.col("line_no") == F.col("terminal_line"), F.col("line")))), r"(?i)^(?:libbpf:\s*)?(?:verifier log:\s*)", "")).alias("terminal_error"), F.max_by(pc, F.when(above & pc.isNotNull(), F.col("line_no"))).alias("pc"),
        F.max_by(start, F.when(above & start.isNotNull(), F.col("line_no"))).alias("start"), F.max((F.trim("line") != "").cast("int")).alias("some"),
    )
    rejected = F.coalesce("pc", F.when(F.col("terminal_error").contains("unknown opcode"), F.col("start")))
    quality = F.when(F.col("some") == 0, LOG_QUALITY[0]).when(F.col("terminal_error").isNull(), LOG_QUALITY[1]).when(rejected.isNull(), LOG_QUALITY[2]).otherwise(LOG_QUALITY[3])
    return out.select("log_id", "terminal_line", "terminal_error", rejected.alias("rejected_pc"), quality.alias("quality"))


def quality_rank(quality: Column) -> Column:
    """0 to 3, from an empty log to one with an error and instructions."""
    return F.coalesce(F.create_map(*(F.lit(x) for k, q in enumerate(LOG_QUALITY) for x in (q, k)))[quality], F.lit(0))


def better_log(logs: DataFrame) -> DataFrame:
    """Of several parsed logs of a case (case_id, quality, priority) the one of the best quality, then of the least priority."""
    w = Window.partitionBy("case_id").orderBy(quality_rank(F.col("quality")).desc(), "priority")
    return logs.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def quoted_pcs(all_lines: DataFrame) -> DataFrame:
    """(log_id, line_no, pc, comment): each instruction with the source line quoted last above it."""
    comment = F.nullif(_found(F.col("line"), COMMENT, 1), F.lit(""))
    w = Window.partitionBy("log_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = all_lines.withColumn("comment", F.last(comment, ignorenulls=True).over(w)).withColumn("pc", _found(F.col("line"), r"^\s*(\d+):", 1).try_cast("int"))
    return rows.where("pc is not null").select("log_id", "line_no", "pc", "comment")


def compact(text: Column) -> Column:
    """A source line without white space."""
    return F.regexp_replace(text, r"\s+", "")


def comment_of_pc(quoted: DataFrame) -> DataFrame:
    """(log_id, pc, comment): the source of each pc's last occurrence that has one."""
    return quoted.where("comment is not null").groupBy("log_id", "pc").agg(F.max_by("comment", "line_no").alias("comment"))


def pcs_of_comment(quoted: DataFrame, wanted: DataFrame) -> DataFrame:
    """(log_id, root_line, pcs): the pcs below each wanted source line (log_id, root_line), white space aside, in log order."""
    met = quoted.withColumn("key", compact(F.col("comment"))).join(wanted.where("root_line <> ''").withColumn("key", compact(F.col("root_line"))), ["log_id", "key"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "pc"))), lambda x: x["pc"])
    return met.groupBy("log_id", "root_line").agg(ordered.alias("pcs"))


def pc_matches(root_pc: Column, pcs: Column) -> Column:
    """A source line may be quoted one instruction late."""
    return F.array_contains(pcs, root_pc) | F.array_contains(pcs, root_pc + 1)


def misaligned_roots(labels: DataFrame, quoted: DataFrame) -> DataFrame:
    """(log_id, error): labels (log_id, root_pc, root_line) whose line is quoted for other pcs only."""
    found = pcs_of_comment(quoted, labels.select("log_id", "root_line").distinct())
    bad = labels.join(found, ["log_id", "root_line"]).where(F.col("root_pc").isNotNull() & (F.size("pcs") > 0) & ~pc_matches(F.col("root_pc"), F.col("pcs")))
    return bad.select("log_id", F.format_string("root line is at %s, not at %d", F.col("pcs").cast("string"), F.col("root_pc")).alias("error"))


def shadowed_roots(labels: DataFrame, quoted: DataFrame) -> DataFrame:
    """(log_id, error): labels (log_id, root_pc, root_line, source_kind, rejected_pc, legacy_pc) that kept a pc of an older numbering,
    where the line now quoted there is another one."""
    stale = labels.where(F.col("source_kind").isin(*LEGACY_SOURCES) & F.col("legacy_pc").isNotNull() & ~F.col("rejected_pc").eqNullSafe(F.col("legacy_pc")) & (F.col("root_pc") == F.col("legacy_pc")) & (F.col("root_line") != ""))
    met = stale.join(comment_of_pc(quoted).withColumnRenamed("pc", "root_pc"), ["log_id", "root_pc"]).where(compact(F.col("comment")) != compact(F.col("root_line")))
    return met.select("log_id", F.format_string("pc %d is of the old numbering; it now quotes %s", F.col("root_pc"), F.col("comment")).alias("error"))


def stored_mismatches(cases: DataFrame, parsed: DataFrame, quoted: DataFrame) -> DataFrame:
    """(log_id, error): cases (log_id, terminal_error, rejected_pc, root_pc) whose stored values differ from what their log says, or whose
    root pc the log never names."""
    p = parsed.select("log_id", F.col("terminal_error").alias("_error"), F.col("rejected_pc").alias("_pc"))
    seen = quoted.select("log_id", F.col("pc").alias("root_pc")).distinct().withColumn("_seen", F.lit(True))
    rows = cases.join(p, "log_id", "left").join(seen, ["log_id", "root_pc"], "left")
    errors = F.array(F.when(~F.col("terminal_error").eqNullSafe(F.col("_error")), F.lit("terminal_error")), F.when(~F.col("rejected_pc").eqNullSafe(F.col("_pc")), F.lit("rejected_pc")), F.when(F.col("root_pc").isNotNull() & F.col("_seen").isNull(), F.lit("root_pc")))
    return rows.select("log_id", F.explode(F.filter(errors, lambda x: x.isNotNull())).alias("error"))


def capture_mismatches(cases: DataFrame, fields: tuple = ("terminal_error", "rejected_pc", "log_quality", "environment_id")) -> DataFrame:
    """(case_id, field): fields of a case's capture that differ from the case itself (columns `field` and `capture_field`)."""
    different = F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"capture_{f}")), F.lit(f)) for f in fields))
    return cases.select("case_id", F.explode(F.filter(different, lambda x: x.isNotNull())).alias("field"))


def enum_violations(rows: DataFrame, key: str, allowed: dict[str, tuple]) -> DataFrame:
    """(key, field, value): values outside the allowed ones, of text fields and of lists."""
    parts = []
    for field, values in allowed.items():
        is_list = rows.schema[field].dataType.typeName() == "array"
        one = rows.select(key, F.explode(field).alias("value")) if is_list else rows.select(key, F.col(field).alias("value"))
        parts.append(one.where(F.col("value").isNotNull() & ~F.col("value").isin(*values)).select(key, F.lit(field).alias("field"), F.col("value").cast("string").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def manifest_violations(manifest: DataFrame, required: tuple = ("schema_version", "corpus", "cases")) -> DataFrame:
    """(manifest_id, field): required fields of manifests that are missing or empty."""
    missing = F.array(*(F.when(F.col(f).isNull() | (F.col(f).cast("string") == ""), F.lit(f)) for f in required))
    return manifest.select("manifest_id", F.explode(F.filter(missing, lambda x: x.isNotNull())).alias("field"))


def case_report(cases: DataFrame, *violations: DataFrame) -> DataFrame:
    """(case_id, n_errors, passed) of all cases, from any number of tables of violations (case_id, ...)."""
    counts = reduce(DataFrame.unionByName, (v.select("case_id") for v in violations)).groupBy("case_id").agg(F.count("*").alias("n"))
    return cases.select("case_id").join(counts, "case_id", "left").select("case_id", F.coalesce("n", F.lit(0)).alias("n_errors"), F.col("n").isNull().alias("passed"))


def report_totals(report: DataFrame) -> DataFrame:
    return report.agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))

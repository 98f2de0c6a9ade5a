"""What a loader's own log says around a rejection: the program being loaded, its section, and relocated struct fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import messages as M
from ..functions.instructions import _found

PROGRAM = r"prog '(.+?)':"
SECTION = r"libbpf: sec '(.+?)': found program '([^']*)'"


def program_scopes(all_lines: DataFrame, points: DataFrame) -> DataFrame:
    """(log_id, before_line, program, window_start) of points (log_id, before_line): the last program whose log begins before the
    point, and where its load starts: behind the last `loading object` line above that, else behind the last end mark, else at 1."""
    rows = all_lines.join(points, "log_id").where("line_no < before_line")
    name = F.when(F.col("line").contains(L.BEGIN_MARK), _found(F.col("line"), PROGRAM, 1))
    begun = rows.withColumn("name", name).where("name is not null").groupBy("log_id", "before_line").agg(F.max_by("name", "line_no").alias("program"), F.max("line_no").alias("begin"))
    above = rows.join(begun, ["log_id", "before_line"]).where("line_no < begin")
    start = above.groupBy("log_id", "before_line").agg(F.max(F.when(F.col("line").startswith("libbpf: loading object"), F.col("line_no"))).alias("loading"), F.max(F.when(F.col("line").contains(L.END_MARK), F.col("line_no"))).alias("ended"))
    return begun.join(start, ["log_id", "before_line"], "left").select("log_id", "before_line", "program", F.coalesce(F.coalesce("loading", "ended") + 1, F.lit(1)).alias("window_start"))


def _scoped(all_lines: DataFrame, scopes: DataFrame) -> DataFrame:
    return all_lines.join(scopes, "log_id").where("line_no >= window_start and line_no < before_line")


def program_sections(all_lines: DataFrame, scopes: DataFrame) -> DataFrame:
    """Adds section to scopes: the last one in which the loader found the program."""
    rows = _scoped(all_lines, scopes).withColumn("section", F.when(_found(F.col("line"), SECTION, 2) == F.col("program"), _found(F.col("line"), SECTION, 1))).where("section is not null")
    found = rows.groupBy("log_id", "before_line").agg(F.max_by("section", "line_no").alias("section"))
    return scopes.join(found, ["log_id", "before_line"], "left")


def relocated_structs(all_lines: DataFrame, scopes: DataFrame, fields: DataFrame) -> DataFrame:
    """(log_id, relocated_struct) of fields (log_id, pc, offset): the struct of the relocation of the scope's program that patched the
    instruction at this pc and offset; of several the last that names one."""
    rows = _scoped(all_lines, scopes).where(_found(F.col("line"), PROGRAM, 1) == F.col("program")).withColumn("relo", M.natural_after(F.col("line"), "relo #")).where("relo is not null")
    at = rows.join(fields, "log_id").where((M.natural_after(F.col("line"), "patched insn #") == F.col("pc")) & ((_after(" off ") == F.col("offset")) | F.coalesce(_after(" -> ") == F.col("offset"), F.lit(False))))
    ids = at.select("log_id", "before_line", "relo").distinct()
    named = rows.join(ids, ["log_id", "before_line", "relo"]).withColumn("name", _found(F.col("line"), r"struct (\w+)", 1)).where("name is not null")
    return named.groupBy("log_id").agg(F.max_by("name", "line_no").alias("relocated_struct"))


def _after(mark: str):
    """The number behind a mark that starts with a space."""
    return _found(F.col("line"), rf"{mark}(\d+)", 1).try_cast("long")


def function_starts(all_lines: DataFrame) -> DataFrame:
    """(log_id, function, pc): where the log says that each function starts, `func#N @pc`."""
    line = F.trim("line")
    found = all_lines.select("log_id", _found(line, r"^func#(\d+) @\d+", 1).try_cast("int").alias("function"), _found(line, r"^func#\d+ @(\d+)", 1).try_cast("int").alias("pc"))
    return found.where("pc is not null")


def mark_ambiguous(programs: DataFrame) -> DataFrame:
    """Programs (log_id, section, attached) with ambiguous: more than one section of a log has states attached."""
    from pyspark.sql import Window

    n = F.sum(F.col("attached").cast("int")).over(Window.partitionBy("log_id"))
    return programs.withColumn("ambiguous", F.col("attached") & (n > 1))


def active_sections(programs: DataFrame) -> DataFrame:
    """(log_id, section): the only section of each log that has states attached."""
    return programs.where("attached").groupBy("log_id").agg(F.count("*").alias("n"), F.first("section").alias("section")).where("n = 1").drop("n")

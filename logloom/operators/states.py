"""From lines to long tables of register and slot states."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import states as S
from ..functions.binding import apart, with_stages
from ..functions.lines import is_boundary
from .storage import kept

#: So many different texts of states are sent to all executors, some 300 bytes each; of more, rows and texts are shuffled.
FEW_TEXTS = 1 << 16


def states(all_lines: DataFrame) -> DataFrame:
    """(log_id, log_line, pc, from_pc, kind, speculative, frame, tokens) of the state lines of (log_id, line_no, line)."""
    rows, x = with_stages(all_lines.select("log_id", F.col("line_no").alias("log_line"), "line"), {"line": F.trim("line")}, S.forms, S.parts)
    text = F.array_compact(F.array(S.kind_text(x)))
    rows = rows.select("log_id", "log_line", *(x[n] for n in ("line", "edge", "is_from", "is_full", "insn")), F.explode(text).alias("_text"))
    return rows.select("log_id", "log_line", *(c.alias(n) for n, c in S.fields(x | {"text": F.col("_text")}).items()))


def malformed_logs(all_lines: DataFrame) -> DataFrame:
    """(log_id): logs with a line that looks like a state and is none. One such line makes all states of its log unusable."""
    return all_lines.where(S.malformed(F.col("line"))).select("log_id").distinct()


def usable_states(all_lines: DataFrame, branch_deltas: bool = True, malformed: DataFrame | None = None) -> DataFrame:
    """The states of logs without a malformed state line (`malformed`, if they are known); those after a conditional branch only if
    asked for."""
    found = states(all_lines).join(malformed_logs(all_lines) if malformed is None else malformed, "log_id", "left_anti")
    return found if branch_deltas else found.where("kind <> 'branch_delta'")


def register_states(found: DataFrame) -> DataFrame:
    """A row for each register of each state; of a register that a line names twice, the last."""
    keys = ["log_id", "log_line", "pc", "frame", "kind"]
    rows = kept(found.select(*keys, F.inline(S.register_texts(F.col("tokens"))).alias("reg", "_narrow", "_value")))
    return with_states(rows, {"_value": "_narrow"}).select(*keys, "reg", "_value_state.*")


def once_for_each(rows: DataFrame, keys: list[str], found: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds to a table what `found` makes of its different values of `keys`, without nulls: logs say the same again and again, and what
    says the same is parsed once. Rows with a null among the keys get nulls."""
    whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    # as many tasks as shuffles have: these are few rows of much work
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = kept(found(rows.where(whole).select(*keys).distinct().repartition(parts)))
    return rows.join(F.broadcast(known) if known.count() <= FEW_TEXTS else known, keys, "left")


def with_states(rows: DataFrame, texts: dict[str, str | None]) -> DataFrame:
    """Adds to a table the states that columns of texts stand for, as `<column>_state`: null for null. `texts` names with each column the
    one that says whether the register is narrow, None for slots, which never are."""

    def parsed(some: DataFrame, c: str, n: str | None) -> DataFrame:
        known, x = with_stages(some, S.start(F.col(c), F.col(n) if n else F.lit(False)), *S.STAGES)
        return known.select(*some.columns, F.struct(*(v.alias(name) for name, v in S.state_fields(x).items())).alias(f"{c}_state"))

    for c, n in texts.items():
        rows = once_for_each(rows, [c, n] if n else [c], lambda some, c=c, n=n: parsed(some, c, n))
    return rows


def slot_states(found: DataFrame) -> DataFrame:
    return found.select("log_id", "log_line", "pc", "frame", F.explode(S.slots(F.col("tokens"))).alias("s")).select("log_id", "log_line", "pc", "frame", "s.*")


def loop_snapshots(all_lines: DataFrame, ends: DataFrame) -> DataFrame:
    """(log_id, current, previous): the states that a log prints as `cur state:` and `old state:` behind its error (log_id, line_no)
    and before the next fragment."""
    behind = all_lines.join(ends.select("log_id", F.col("line_no").alias("end")), "log_id").where("line_no > end").withColumn("line", F.trim("line"))
    edge = F.min(F.when(is_boundary(F.col("line")), F.col("line_no"))).over(Window.partitionBy("log_id"))
    behind = behind.withColumn("edge", edge).where("edge is null or line_no < edge")
    first = lambda mark: F.min_by(F.when(F.col("line").startswith(mark), S.state(F.concat(F.lit("0: "), F.trim(F.substring("line", len(mark) + 1, 1 << 20))))), F.when(F.col("line").startswith(mark), F.col("line_no")))
    return behind.groupBy("log_id").agg(first("cur state:").alias("current"), first("old state:").alias("previous")).where("current is not null and previous is not null")

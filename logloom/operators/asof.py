"""Latest-state-before lookups, pointer lineage and path snapshots, over states in log order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(points: DataFrame, states: DataFrame, keys: list[str], order: str, value: Column, *, inclusive: bool = False, where: Column | None = None, name: str = "value") -> DataFrame:
    """Adds to each point the value of the last state of the same keys before it (or at it, if inclusive) that meets `where`.

    States and points are merged and read once in order: one shuffle on the keys, one sort, no join. `order` is a number in both.
    """
    tag = 0 if inclusive else 1  # at equal places, inclusive lookups see the states first
    met = states if where is None else states.where(where)
    both = met.select(*keys, F.col(order), F.struct(value.alias("v")).alias("_state"), F.lit(tag).alias("_tag"), F.lit(None).cast(points.schema.simpleString()).alias("_point"))
    ours = points.select(*keys, F.col(order), F.lit(None).cast(both.schema["_state"].dataType).alias("_state"), F.lit(1 - tag).alias("_tag"), F.struct(*points.columns).alias("_point"))
    w = Window.partitionBy(*keys).orderBy(order, "_tag").rowsBetween(Window.unboundedPreceding, 0)
    found = both.unionByName(ours).withColumn("_last", F.last("_state", ignorenulls=True).over(w)).where("_point is not null")
    return found.select("_point.*", F.col("_last.v").alias(name))


#: Bits of a pc that one level of the look-up below reads.
DIGIT = 4


def latest_line_below(points: DataFrame, states: DataFrame, keys: list[str], point: list[str], *, inclusive: bool = False, bits: int = 20, name: str = "found_line") -> DataFrame:
    """Adds to points (keys, point, log_line, pc) the greatest log_line of the states (keys, log_line, pc) of the same keys before their
    line (or at it, if inclusive) whose pc is not above theirs. `point` names columns that tell points apart.

    pc does not follow log order, so the bound by pc is taken digit by digit, of 16 values each, as in a tree of that width: a pc below
    the bound has the bound's leading digits, then a smaller one. States and points are filed under each length of leading digits; one
    ordered pass remembers the last line of each next digit, and a point takes the greatest of those below its own (and, of the last
    digit, of its own). With n states and points of `bits` bits that is n * bits / 4 narrow rows, and no state meets a point."""
    levels = F.sequence(F.lit(0), F.lit(-(-bits // DIGIT) - 1))
    filed = lambda df, bound, rest: df.select(*keys, "log_line", F.explode(levels).alias("_level"), bound.alias("_pc"), rest.alias("_point")).withColumn("_digit", F.expr(f"shiftright(_pc, _level * {DIGIT})").bitwiseAND((1 << DIGIT) - 1)).withColumn("_prefix", F.expr(f"shiftright(_pc, (_level + 1) * {DIGIT})")).drop("_pc")
    whole = F.struct(*points.columns)
    seen = filed(states.select(*keys, "log_line", F.col("pc").cast("long").alias("_p")), F.col("_p"), F.lit(None).cast(points.select(whole.alias("p")).schema["p"].dataType))
    asked = filed(points.withColumn("_p", F.least(F.col("pc").cast("long"), F.lit((1 << bits) - 1))), F.col("_p"), whole)
    # text, since the drivers of short jobs would spend their time on building some hundred column objects for each look-up
    first = "_point IS NULL" if inclusive else "_point IS NOT NULL"
    over = f"OVER (PARTITION BY {', '.join(keys)}, _level, _prefix ORDER BY log_line, IF({first}, 0, 1) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    both = seen.unionByName(asked)
    last = [f"last(IF(_point IS NULL AND _digit = {k}, log_line, NULL), true) {over} AS _last{k}" for k in range(1 << DIGIT)]
    met = both.selectExpr("*", *last).where("_point is not null")
    below = F.expr(f"greatest({', '.join(f'IF(_digit > {k} OR (_level = 0 AND _digit = {k}), _last{k}, NULL)' for k in range(1 << DIGIT))})")
    best = met.select("_point", below.alias("_line")).groupBy(*(F.col(f"_point.{c}").alias(c) for c in point)).agg(F.first("_point").alias("_point"), F.max("_line").alias("_line"))
    return best.select("_point.*", F.col("_line").alias(name))


def latest_bounded(points: DataFrame, states: DataFrame, keys: list[str], value: Column, *, inclusive: bool = False, name: str = "value", bits: int = 20) -> DataFrame:
    """As `latest` by log_line, of states whose pc is at most the point's too (`latest_line_below`). Points need a unique column point_id,
    states one row for each keys and log_line; pcs have `bits` bits at most. Only lines go through the look-up; the value comes last."""
    near = latest_line_below(points, states.select(*keys, "log_line", "pc"), keys, ["point_id"], inclusive=inclusive, bits=bits, name="_line")
    values = states.select(*keys, F.col("log_line").alias("_line"), value.alias(name))
    return near.join(values, [*keys, "_line"], "left").select(*points.columns, name)


def lost_pointers(states: DataFrame, is_pointer: Column, is_scalar: Column) -> DataFrame:
    """The last scalar state of each (log_id, reg) that had a pointer state earlier, with that pointer's type.

    A loss does not end the pointer's kind: it is carried on without reset."""
    w = Window.partitionBy("log_id", "reg").orderBy("log_line").rowsBetween(Window.unboundedPreceding, -1)
    seen = states.withColumn("pointer_type", F.last(F.when(is_pointer, F.col("reg_type")), ignorenulls=True).over(w)).where(is_scalar & F.col("pointer_type").isNotNull())
    return seen.groupBy("log_id", "reg").agg(F.max("log_line").alias("log_line"), F.max_by("pc", "log_line").alias("pc"), F.max_by("pointer_type", "log_line").alias("pointer_type"))


def path_snapshots(states: DataFrame, resets: Column, key: str = "reg", value: str = "value") -> DataFrame:
    """(log_id, segment, key, value): deltas folded since the last state that `resets`, the latest value of each key."""
    w = Window.partitionBy("log_id").orderBy("log_line")
    segment = F.sum(resets.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return states.withColumn("segment", segment).groupBy("log_id", "segment", key).agg(F.max_by(value, "log_line").alias(value), F.max("log_line").alias("log_line"))


def floored_depth(rows: DataFrame, step: Column, partition: list[str], order: list) -> DataFrame:
    """Adds depth: a running sum of steps that never falls below zero, without a loop over rows.

    It is the plain running sum less the lowest value that this has had, as far as that is below zero."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_sum", F.sum(step).over(w))
    return summed.withColumn("depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(w))).drop("_sum")


def dead_sites(states: DataFrame, site: list[str], speculative: Column) -> DataFrame:
    """(site, visits) of sites that are reached speculatively only."""
    return states.groupBy(*site).agg(F.bool_and(speculative).alias("_dead"), F.count("*").alias("visits")).where("_dead").drop("_dead")


def latest_where(states: DataFrame, keys: list[str], condition: Column, *values: str) -> DataFrame:
    """(keys, log_line, values): the last state of each key that meets a condition."""
    return states.where(condition).groupBy(*keys).agg(F.max("log_line").alias("log_line"), *(F.max_by(v, "log_line").alias(v) for v in values))


def agreed(states: DataFrame, site: list[str], value: str) -> DataFrame:
    """(site, value): the value that all states at a site share; null if they differ or one has none."""
    same = (F.min(value) == F.max(value)) & (F.count(value) == F.count("*"))
    return states.groupBy(*site).agg(F.when(same, F.min(value)).alias(value))


def segments_by_change(rows: DataFrame, column: str, partition: list[str], order: list, name: str = "segment") -> DataFrame:
    """Numbers the runs of equal values in order: a lineage ends where its type changes."""
    w = Window.partitionBy(*partition).orderBy(*order)
    changed = (~F.col(column).eqNullSafe(F.lag(column).over(w))).cast("int")
    return rows.withColumn("_changed", changed).withColumn(name, F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")

"""A value that an expression names several times and that is computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row.

    The optimizer replaces a name by what it stands for, at each of its uses, when it moves filters below projections. A large
    predicate over a computed line would then compute the line dozens of times. The variable of a higher-order function cannot
    be replaced."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def named(fields: dict[str, Column]) -> Column:
    """A struct of these fields. Inside the function of an array function an alias may be dropped before a struct takes its name."""
    return F.named_struct(*(x for name, value in fields.items() for x in (F.lit(name), value)))


def through(start: dict[str, Column], *stages: Callable) -> Column:
    """What the last of `stages` makes of all fields before it; each other stage gets the fields so far and returns more of them."""

    def go(fields: dict[str, Column], rest: tuple) -> Column:
        if len(rest) == 1:
            return let(named(fields), rest[0])
        return let(named(fields), lambda x: go({**{n: x[n] for n in fields}, **rest[0](x)}, rest[1:]))

    return go(start, stages)


def apart(value: Column) -> Column:
    """`value`, in a projection that is not fused with its neighbours.

    Spark fuses projections into one method, and the JVM never compiles one of more than 8,000 bytes: a parser of some hundred expressions
    would be interpreted. Functions of arrays are not fused, and what they stand beside is cut into small methods."""
    return let(value, lambda x: x)


def with_stages(df: DataFrame, start: dict[str, Column], *stages: Callable) -> tuple[DataFrame, dict[str, Column]]:
    """`df` with the fields of `through` as columns, their names with a mark before them, and these columns by name.

    Columns that a later one names several times are computed once, and in generated code, which functions of arrays are not. A filter
    over them would be moved below them, and compute them again: `explode` what must not be null."""
    known: dict[str, Column] = {}
    for stage in (lambda _: start, *stages):
        new = stage(known)
        first = next(iter(new))
        df = df.withColumns({f"_{n}": apart(c) if n == first else c for n, c in new.items()})
        known |= {n: F.col(f"_{n}") for n in new}
    return df, known

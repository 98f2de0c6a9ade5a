"""Runs a query and its SQL over the same folder of tables, and returns the rows of both in comparable form."""

from __future__ import annotations

import datetime
import decimal

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _value(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (int, decimal.Decimal)):
        return str(int(x)) if x == int(x) else str(float(x))
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return str(x)


def comparable(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(_value(r[i]) for i in order) for r in rows)


def of_sql(con, sql):
    found = con.execute(sql)
    return comparable([d[0] for d in found.description], found.fetchall())


def of_frame(df):
    return comparable(df.columns, [tuple(r) for r in df.collect()])

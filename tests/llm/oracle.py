"""Compares a query with its SQL over one of the synthetic tables' folders."""

import duckdb

TABLES = ("documents", "pages", "benchmark", "labels", "embeddings", "conversations", "events", "lineitem", "orders", "customer", "supplier", "part", "nation", "region")


def rows_of_sql(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return sorted((tuple(str(v) for _, v in sorted(zip(names, r, strict=True))) for r in found.fetchall()), key=str), sorted(names)


def rows_of_frame(df):
    names = df.columns
    return sorted((tuple(str(v) for _, v in sorted(zip(names, r, strict=True))) for r in df.collect()), key=str), sorted(names)

"""Shared comparison of a Spark result with a DuckDB statement."""
import datetime as dt
import math

import duckdb

from tessera.sources.tables import TABLES, table_path


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 5):.5f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{norm(k)}:{norm(x)}" for k, x in sorted(v.items(), key=lambda t: str(t[0]))) + "}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted("|".join(norm(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def compare(df, con, sql):
    sc, srows = canon(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    dc, drows = canon([d[0] for d in res.description], res.fetchall())
    return sc == dc and srows == drows, (sc, dc, len(srows), len(drows))

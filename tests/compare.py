"""Side-by-side run of a registered query and its DuckDB counterpart."""

from __future__ import annotations

import datetime as dt
import math
import os

import duckdb

from aeroframe.catalog.inputs import TABLES


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return f"{x:.6g}" if abs(x) < 1e-3 else f"{x:.5f}"
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


def kind(x):
    if isinstance(x, bool):
        return "bool"
    return "number" if isinstance(x, float) else type(x).__name__


def rows_of(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in records)


def spark_rows(df):
    return rows_of(df.collect(), df.columns), sorted(df.columns)


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return rows_of(cur.fetchall(), names), sorted(names)


def families(df, con, sql):
    """Coarse type per column on both sides."""
    def fam(t):
        t = t.lower()
        for name, marks in (("float", ("double", "float")), ("decimal", ("decimal", "hugeint")), ("int", ("int", "long")),
                            ("bool", ("bool",)), ("time", ("timestamp",)), ("date", ("date",))):
            if any(m in t for m in marks):
                return name
        return "text"
    ours = {n: fam(t) for n, t in df.dtypes}
    theirs = {row[0]: fam(row[1]) for row in con.execute(f"DESCRIBE {sql}").fetchall()}
    return ours, theirs

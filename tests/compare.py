"""Rows of a DataFrame and of DuckDB SQL, in one comparable form."""

from __future__ import annotations

import math
import os
from decimal import Decimal


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (float, Decimal)):
        return str(int(x)) if x == int(x) and abs(x) < 1e15 else f"{round(float(x), 6)}"
    return str(x)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(cell(v) for v in r) for r in df.select(*columns).collect()), key=str)


def duck_rows(sql: str, folder: str):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(folder):
        name, _, kind = f.partition(".")
        if kind == "parquet":
            path = os.path.join(folder, f)
            c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = c.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    return [found.columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in found.fetchall()), key=str)

"""Comparison of a Spark result with its SQL counterpart."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os

import duckdb


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    cells = [tuple(_cell(row[i]) for i in order) for row in rows]
    return names, sorted(cells, key=repr)


def spark_rows(df):
    return _rows(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return _rows(columns, cursor.fetchall())


def kinds(rows):
    """Type name of the first non-null value per column."""
    names, cells = rows
    found = []
    for i in range(len(names)):
        found.append(next((type(r[i]).__name__ for r in cells if r[i] is not None), None))
    return dict(zip(names, found))

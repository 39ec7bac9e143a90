"""Comparing a query's rows with DuckDB's over the same files, as strings without order."""

from __future__ import annotations

import os
from glob import glob

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return con


def rows_of_sql(con, sql: str) -> tuple[list[str], list[tuple]]:
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in got.fetchall())


def rows_of_frame(frame) -> tuple[list[str], list[tuple]]:
    names = sorted(frame.columns)
    return names, sorted(tuple(_plain(v) for v in r) for r in frame.select(*names).collect())


def _plain(v) -> str:
    return repr(float(v)) if isinstance(v, float) else repr(v)

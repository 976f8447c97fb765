"""Rows of a query beside the rows of its SQL."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, "" if v is None else repr(round(v, 5)) if isinstance(v, float) else repr(v)) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, (float, int)):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9)
    return a == b


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if both have the same columns and rows; else what differs first."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want = found.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)}, not {sorted(names)}"
    got = sorted((tuple(r) for r in spark_df.select(*[f"`{n}`" for n in names]).collect()), key=_key)
    want = sorted(want, key=_key)
    if len(got) != len(want):
        return f"{len(got)} rows, not {len(want)}"
    for a, b in zip(got, want):
        if not all(map(_same, a, b)):
            return f"{dict(zip(names, a))} is not {dict(zip(names, b))}"
    return None

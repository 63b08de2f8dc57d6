"""A query's rows against its SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        files = sorted(glob.glob(f"{p}/*.parquet")) if os.path.isdir(p) else [p]
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({files!r})")
    return c


def rows(names: list[str], values) -> list[str]:
    order = sorted(range(len(names)), key=names.__getitem__)
    show = lambda v: "NULL" if v is None else str(int(v)) if isinstance(v, bool) else repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted("|".join(show(r[i]) for i in order) for r in values)


def differences(df, sql: str, c: duckdb.DuckDBPyConnection) -> str:
    """Empty if both give the same columns and rows."""
    out = c.sql(sql)
    if sorted(df.columns) != sorted(out.columns):
        return f"columns {sorted(df.columns)} and {sorted(out.columns)}"
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(out.columns, out.fetchall())
    if a != b:
        only = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return f"{len(a)} and {len(b)} rows; only in one: {only}"
    return ""

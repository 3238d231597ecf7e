"""Compare queries with DuckDB on the same tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def rows(columns: list[str], got) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in got), key=repr)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a DataFrame and the SQL's rows, in words; empty if nothing does."""
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    want, got = rows(names, answer.fetchall()), rows(df.columns, df.collect())
    if len(want) != len(got):
        return [f"{len(got)} rows, SQL has {len(want)}"]
    return [f"{g} and {w}" for g, w in zip(got, want, strict=True) if g != w][:3]

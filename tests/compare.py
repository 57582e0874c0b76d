"""Compare a Spark result with DuckDB SQL over the same tables, as sets of rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float) and x == int(x):
        return str(int(x))
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(_plain(r[k]) for k in order) for r in rows)


def differences(df, con, sql: str) -> list[str]:
    """Empty when columns and rows agree."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return [f"columns {got[0]} and {want[0]}"]
    if got[1] == want[1]:
        return []
    a, b = set(got[1]), set(want[1])
    return [f"rows {len(got[1])} and {len(want[1])}", f"only here {sorted(a - b)[:3]}", f"only there {sorted(b - a)[:3]}"]

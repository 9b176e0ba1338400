"""Holds a query's rows against its DuckDB SQL."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(_norm, v))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v if isinstance(v, (int, str, bool, bytes, type(None))) else _norm(float(v))


def differences(df, con, sql: str) -> list[str]:
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    theirs = sorted((tuple(_norm(r[names.index(c)]) for c in sorted(names)) for r in res.fetchall()), key=repr)
    rows = df.collect()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    ours = sorted((tuple(_norm(r[c]) for c in sorted(names)) for r in rows), key=repr)
    if ours == theirs:
        return []
    a, b = set(ours), set(theirs)
    return [f"{len(ours)} rows and {len(theirs)}", f"only ours {list(a - b)[:2]}", f"only theirs {list(b - a)[:2]}"]

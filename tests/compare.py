"""Hold each query against its SQL in DuckDB: the same columns, rows and values, in any order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].replace("T00:00:00", "")
    try:
        return round(float(v), 3) + 0.0
    except (TypeError, ValueError):
        return str(v)


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in records), key=repr)


def differences(spark, con, query, sql, sf_dir) -> str:
    """Empty if both agree."""
    df = query(spark, sf_dir)
    got = df.collect()
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(got, df.columns), rows(want, names)
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}"
    off = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(off)} of {len(a)} rows differ: {off[0]}" if off else ""

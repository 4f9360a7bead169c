"""Side-by-side check of a Spark query and its DuckDB oracle (used by tests and check.py)."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, [tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect()]


def rows_of_duck(con, sql):
    rel = con.sql(sql)
    cols = rel.columns
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    data = rel.fetchall()
    return [cols[i] for i in order], [tuple(_norm(r[i]) for i in order) for r in data]


def compare(df, con, sql):
    """Return (ok, message)."""
    sc, sr = rows_of_spark(df)
    dc, dr = rows_of_duck(con, sql)
    if sc != dc:
        return False, f"columns differ: spark={sc} duckdb={dc}"
    if len(sr) != len(dr):
        return False, f"row count spark={len(sr)} duckdb={len(dr)}"
    key = lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t)
    ss, ds = sorted(sr, key=key), sorted(dr, key=key)
    bad = [(a, b) for a, b in zip(ss, ds) if a != b]
    if bad:
        return False, f"{len(bad)} rows differ, e.g. spark={bad[0][0]} duckdb={bad[0][1]}"
    return True, f"{len(sr)} rows"

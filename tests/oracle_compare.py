"""Local stand-in for the driver's correctness gate.

Runs a registered Spark query and its DuckDB oracle on the same sf folder and
compares row count, column names and an order-insensitive value hash (doubles
rounded, columns sorted by name).
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import sys

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _norm(x)) for k, x in v.asDict().items()))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def compare(spark, name, fn, sql, sf_dir, con=None, show=3):
    con = con or duck(sf_dir)
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    rel = con.execute(sql)
    d_cols = [c[0] for c in rel.description]
    d_rows = rel.fetchall()
    ok_cols = sorted(s_cols) == sorted(d_cols)
    hs, ls = digest(s_cols, s_rows)
    hd, ld = digest(d_cols, d_rows)
    ok = ok_cols and len(s_rows) == len(d_rows) and hs == hd
    if not ok:
        print(f"[{name}] MISMATCH cols_ok={ok_cols} spark={sorted(s_cols)} duck={sorted(d_cols)} "
              f"rows {len(s_rows)} vs {len(d_rows)}", file=sys.stderr)
        sset, dset = set(ls), set(ld)
        for x in list(sset - dset)[:show]:
            print("  spark-only", x[:300], file=sys.stderr)
        for x in list(dset - sset)[:show]:
            print("  duck-only ", x[:300], file=sys.stderr)
    return ok, len(s_rows)

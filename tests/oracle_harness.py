"""Run a registered query and its DuckDB oracle side by side (the driver's check)."""
from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> tuple[bool, str]:
    df = query(spark, sf_dir)
    s_cols = sorted(df.columns)
    s_rows = Counter(tuple(_norm(r[c]) for c in s_cols) for r in df.collect())
    cur = con.execute(sql)
    d_cols_raw = [c[0] for c in cur.description]
    d_rows_raw = cur.fetchall()
    order = sorted(range(len(d_cols_raw)), key=lambda i: d_cols_raw[i])
    d_cols = [d_cols_raw[i] for i in order]
    d_rows = Counter(tuple(_norm(r[i]) for i in order) for r in d_rows_raw)
    if s_cols != d_cols:
        return False, f"{name}: columns differ spark={s_cols} duck={d_cols}"
    if s_rows != d_rows:
        only_s = list((s_rows - d_rows).elements())[:3]
        only_d = list((d_rows - s_rows).elements())[:3]
        return False, (f"{name}: rows differ spark={sum(s_rows.values())} duck={sum(d_rows.values())}"
                       f" only_spark={only_s} only_duck={only_d}")
    return True, f"{name}: ok ({sum(s_rows.values())} rows)"

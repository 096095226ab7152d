"""Spark-vs-DuckDB comparison in the shape of the driver's correctness check:
row count, column names, and an order-insensitive hash of the values."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math

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
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return str(v)


def digest(cols: list[str], rows: list[tuple]) -> str:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def compare(spark, name: str, query, sql: str, sf_dir: str, con=None) -> dict:
    df = query(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    con = con or duck(sf_dir)
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    out = {
        "query": name,
        "spark_rows": len(s_rows), "oracle_rows": len(d_rows),
        "schema_match": sorted(s_cols) == sorted(d_cols),
        "spark_cols": s_cols, "oracle_cols": d_cols,
    }
    out["rows_match"] = out["spark_rows"] == out["oracle_rows"]
    out["value_match"] = out["schema_match"] and digest(s_cols, s_rows) == digest(d_cols, d_rows)
    if not out["value_match"] and out["schema_match"]:
        order_s = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
        order_d = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
        ss = sorted(repr(tuple(_norm(r[i]) for i in order_s)) for r in s_rows)
        dd = sorted(repr(tuple(_norm(r[i]) for i in order_d)) for r in d_rows)
        sset, dset = set(ss), set(dd)
        out["only_spark"] = [x for x in ss if x not in dset][:3]
        out["only_oracle"] = [x for x in dd if x not in sset][:3]
    return out

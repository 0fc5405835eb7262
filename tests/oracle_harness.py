"""Runs a registered Spark query and its DuckDB SQL on the same parquet
tables and compares row count, column names and values (order-insensitive)."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        return round(f, 6)
    if isinstance(v, int):
        return v
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return str(v)


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def compare(spark, con, name: str, build, sql: str, sf_dir: str) -> dict:
    sdf = build(spark, sf_dir)
    s_cols = list(sdf.columns)
    s_types = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    s_rows = [tuple(r) for r in sdf.collect()]
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_types = {c: str(t) for c, t in zip(con.sql(sql).columns, con.sql(sql).types)}
    d_rows = res.fetchall()
    out = {"name": name, "spark_rows": len(s_rows), "duck_rows": len(d_rows)}
    if sorted(s_cols) != sorted(d_cols):
        out.update(ok=False, why=f"columns differ: {sorted(s_cols)} vs {sorted(d_cols)}")
        return out
    bad_types = [(c, t, d_types.get(c)) for c, t in s_types.items()
                 if SPARK_TO_DUCK.get(t, t.upper()) != d_types.get(c)]
    if bad_types:
        out.update(ok=False, why=f"types differ: {bad_types}")
        return out
    order = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    d_index = {c: i for i, c in enumerate(d_cols)}
    s_norm = sorted((tuple(_norm(r[i]) for i in order) for r in s_rows), key=_key)
    d_norm = sorted((tuple(_norm(r[d_index[s_cols[i]]]) for i in order) for r in d_rows), key=_key)
    if s_norm != d_norm:
        diff = [(a, b) for a, b in zip(s_norm, d_norm) if a != b][:3]
        out.update(ok=False, why=f"values differ, first: {diff}")
        return out
    out["ok"] = True
    return out

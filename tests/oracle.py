"""Side-by-side check of a registered Spark query against its DuckDB oracle.

Mirrors the driver's gate: row count, column names, and an order-insensitive hash of
the values with columns sorted by name.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math

import duckdb
import pandas as pd

from pitloom.fixtures import BASE_TABLES


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v) -> str:
    if v is None or v is pd.NaT:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        return repr(float(f"{v:.10g}"))
    if isinstance(v, decimal.Decimal):
        return repr(float(f"{float(v):.10g}"))
    if isinstance(v, (pd.Timestamp, dt.datetime)):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return _cell(v.tolist())
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int,)):
        return str(v)
    return str(v)


def frame_digest(pdf: pd.DataFrame) -> tuple[int, list[str], str]:
    cols = sorted(pdf.columns)
    rows = []
    for rec in pdf[cols].astype(object).itertuples(index=False, name=None):
        rows.append("\x1f".join(_cell(x) for x in rec))
    rows.sort()
    h = hashlib.sha256("\n".join(rows).encode()).hexdigest()
    return len(pdf), cols, h


def compare(spark, name: str, sf_dir: str, con: duckdb.DuckDBPyConnection | None = None) -> dict:
    from pitloom.plans.catalog import ORACLE, QUERIES

    sdf = QUERIES[name](spark, sf_dir).toPandas()
    con = con or duck_connection(sf_dir)
    odf = con.sql(ORACLE[name]).df()
    sn, scols, sh = frame_digest(sdf)
    on, ocols, oh = frame_digest(odf)
    def kinds(df):
        out = {}
        for c in sorted(df.columns):
            k = df[c].dtype.kind if hasattr(df[c].dtype, "kind") else "O"
            out[c] = str(df[c].dtype) if df[c].dtype.kind in "iufb" else {"M": "time", "O": "object"}.get(k, k)
        return out

    sk, ok = kinds(sdf), kinds(odf)
    return {
        "dtype_diff": {c: (sk[c], ok.get(c)) for c in sk if sk[c] != ok.get(c)},
        "name": name,
        "rows": (sn, on),
        "rows_match": sn == on,
        "schema_match": scols == ocols,
        "hash_match": sh == oh,
        "spark": sdf,
        "oracle": odf,
    }

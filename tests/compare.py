"""Order-insensitive comparison of a Spark result with DuckDB SQL over the same tables."""

import glob
import os

import duckdb
import pandas as pd


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return con


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NA:
            return None
        if isinstance(v, bool) or type(v).__name__ in ("bool", "bool_"):
            return bool(v)
        if isinstance(v, str):
            return v
        return round(float(v), 5) + 0.0

    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


def differences(spark_frame: pd.DataFrame, sql: str, con) -> str:
    other = con.sql(sql).df()
    if sorted(spark_frame.columns) != sorted(other.columns):
        return f"columns {sorted(spark_frame.columns)} and {sorted(other.columns)}"
    a, b = rows(spark_frame), rows(other)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b) if any((p is None) != (q is None) or (p != q and not (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-5 * max(1, abs(p)))) for p, q in zip(x, y))]
    return f"{len(bad)} rows differ, as {bad[0]}" if bad else ""

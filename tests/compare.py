"""Compare a Spark result with DuckDB's result for the same query."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{directory}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else float(f"{value:.12g}")
    if isinstance(value, int):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value) if isinstance(value, dt.date) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return sorted(columns), rows_of(columns, cur.fetchall())


def differences(df, con, sql, limit=4):
    """Empty when both results agree exactly."""
    columns, expected = duck_rows(con, sql)
    if sorted(df.columns) != columns:
        return [f"columns {sorted(df.columns)} != {columns}"]
    got = spark_rows(df)
    out = [] if len(got) == len(expected) else [f"rows {len(got)} != {len(expected)}"]
    in_got, in_expected = set(got), set(expected)
    only_spark, only_sql = [r for r in got if r not in in_expected], [r for r in expected if r not in in_got]
    for a, b in list(zip(only_spark, only_sql))[:limit]:
        out.append(f"spark {a}\n      sql   {b}")
    if len(only_spark) != len(only_sql):
        out.append(f"{len(only_spark)} rows only in spark {only_spark[:2]}, {len(only_sql)} only in sql {only_sql[:2]}")
    elif only_spark:
        out.append(f"{len(only_spark)} rows differ")
    return out

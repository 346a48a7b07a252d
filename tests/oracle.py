"""Compares a query's rows with its SQL in DuckDB, value by value."""

import datetime
import glob
import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    return v


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, Counter(tuple(_plain(r[n]) for n in names) for r in (x.asDict(recursive=True) for x in df.collect()))


def rows_of_sql(con, sql: str):
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, Counter(tuple(_plain(r[i]) for i in at) for r in got.fetchall())


def assert_same(df, con, sql: str) -> None:
    names, rows = rows_of_spark(df)
    expected_names, expected = rows_of_sql(con, sql)
    assert names == expected_names
    assert not (rows - expected) and not (expected - rows), (list((rows - expected).items())[:3], list((expected - rows).items())[:3])

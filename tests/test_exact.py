"""Queries against their SQL to the last bit, on values that the test tables lack."""

import random

import duckdb

from axisloom import queries as core


def test_sql_functions_to_the_last_bit(spark, tmp_path):
    """Large values, values of many decimals, ties of the sixth decimal, none and NaN."""
    rng = random.Random(4)
    values = [None, float("nan"), 0.5, 0.0, 36783.66, 36789.91, 128.5, 640.5, 1e9 + 0.37] + [rng.expovariate(0.01) for _ in range(20_000)] + [round(rng.uniform(-1e3, 1e5), 2) for _ in range(20_000)]
    table = spark.createDataFrame(list(enumerate(values)), "event_id long, value double")
    table.write.parquet(f"{tmp_path}/events.parquet")
    df = core.QUERIES["sql_functions"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = con.execute(core.ORACLE["sql_functions"])
    names = [c[0] for c in got.description]
    expected = {r[0]: tuple(map(repr, r)) for r in got.fetchall()}
    found = {r["event_id"]: tuple(repr(r[n]) for n in names) for r in df.collect()}
    assert df.columns == names and found.keys() == expected.keys()
    assert {k: (v, expected[k]) for k, v in found.items() if v != expected[k]} == {}

"""Registered queries against their SQL in DuckDB, where the test tables are there."""

import glob
import math
import os

import pandas as pd
import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows(df):
    return sorted(str([plain(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False))


def test_core_queries_match_their_sql(spark):
    import duckdb

    from biblion.queries import collect

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    queries, sql = collect()
    assert set(sql) <= set(queries)
    for name, text in sql.items():
        got, want = queries[name](spark, DATA).toPandas(), con.execute(text).df()
        assert sorted(got.columns) == sorted(want.columns), name
        assert rows(got) == rows(want), name

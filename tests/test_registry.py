"""Every query with SQL against DuckDB on the smallest tables; the others must give rows of a stable schema."""

import math
import os

import duckdb
import pytest

from strataframe import registry

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(names, data):
    return sorted(str([plain(v) for v in t]) for t in data)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    got = df.collect()
    assert df.columns
    sql = registry.ORACLE_SQL.get(name)
    if sql is None:
        return
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = [[r[names.index(n)] for n in sorted(names)] for r in cur.fetchall()]
    assert rows(names, [[r[n] for n in sorted(names)] for r in got]) == rows(names, want)

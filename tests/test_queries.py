"""Every registered query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from waymill.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    res = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted((tuple(plain(r[i]) for i in order) for r in res.fetchall()), key=repr)
    assert sorted(df.columns) == sorted(names)
    assert got == want

"""Every query against its SQL twin on the smallest tables."""

import math

import duckdb
import pytest

from specgraph.plans import catalog
from specgraph.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"
KNOWN = sorted(catalog.QUERIES)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return None if math.isnan(x) else round(float(x), 6)
    return x


@pytest.mark.parametrize("name", KNOWN)
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    if name in catalog.SQL:
        out = duck.sql(catalog.SQL[name])
        assert sorted(out.columns) == cols
        at = [out.columns.index(c) for c in cols]
        assert rows == sorted(repr(tuple(plain(r[i]) for i in at)) for r in out.fetchall())


def test_twins_have_queries():
    assert set(catalog.SQL) <= set(catalog.QUERIES)

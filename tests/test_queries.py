"""Every registered query that has SQL gives what DuckDB gives, on the smallest tables."""

import math
import os

import duckdb
import pytest

from pagemill.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("pages", "events", "conversations", "part", "supplier", "documents", "customer", "orders", "lineitem"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rel = con.execute(registry.ORACLES[name])
    names = [d[0] for d in rel.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert sorted(names) == cols
    assert sorted(tuple(plain(r[c]) for c in cols) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    got = registry.QUERIES[name](spark, SF)
    assert len(got.collect()) > 0 and got.columns

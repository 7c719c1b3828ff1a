"""Every query with SQL against that SQL, and the driver's entry."""

import math
from decimal import Decimal

import duckdb
import pytest

from sightline import registry
from sightline.plans import catalog  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return f"{float(v):.5f}" if isinstance(v, (float, Decimal)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL) + sorted(registry.FIXTURES))
def test_sql(spark, con, name):
    run, sql = registry.FIXTURES.get(name) or (registry.QUERIES[name], registry.ORACLE_SQL[name])
    got = run(spark, FOLDER)
    cols = sorted(got.columns)
    want = con.execute(sql)
    order = [d[0] for d in want.description]
    assert sorted(order) == cols
    key = lambda r: tuple((x is None, x or "") for x in r)
    a = sorted((tuple(cell(r[c]) for c in cols) for r in got.collect()), key=key)
    b = sorted((tuple(cell(r[order.index(c)]) for c in cols) for r in want.fetchall()), key=key)
    assert a == b


def test_queries_without_sql_have_rows(spark):
    for name in sorted(registry.QUERIES.keys() - registry.ORACLE_SQL.keys()):
        assert registry.QUERIES[name](spark, FOLDER).count() > 0, name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

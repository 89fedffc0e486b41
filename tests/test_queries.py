import math
import os

import duckdb
import pytest

from larkspur.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def views():
    connection = duckdb.connect()
    for name in os.listdir(DATA):
        if name.endswith(".parquet"):
            connection.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DATA}/{name}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return bytes(value) if isinstance(value, bytearray) else value


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, views, name):
    got = catalog.queries()[name](spark, DATA)
    sql = catalog.oracle_sql().get(name)
    if not sql:
        assert got.count() >= 0
        return
    want = views.sql(sql)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    listed = lambda rows: sorted(([plain(v) for v in r] for r in rows), key=repr)
    order = [want.columns.index(c) for c in columns]
    assert listed(got.select(*columns).collect()) == listed([[r[k] for k in order] for r in want.fetchall()])

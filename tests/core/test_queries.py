"""Every query of the tables against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from geoflume.plans.queries import ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    out = con.execute(ORACLE[name])
    names = [c[0] for c in out.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(df.columns) == sorted(names)
    assert got == sorted((tuple(r[i] for i in order) for r in out.fetchall()), key=repr)


def test_entry_has_all():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())

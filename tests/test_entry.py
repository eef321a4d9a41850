"""The driver's contract: core queries equal their SQL on the smallest data."""

import os

import pytest

from taxonaut.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    expected = duck.sql(catalog.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(expected.columns)
    rows = lambda got, columns: sorted(tuple(repr(r[columns.index(c)]) for c in order) for r in got)
    assert rows(df.collect(), df.columns) == rows(expected.fetchall(), expected.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""The driver's contract on the smallest tables, and every query against its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from folioq.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, DIR).toPandas()
    if name in catalogue.ORACLES:
        wanted = con.execute(catalogue.ORACLES[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(wanted.columns)
        assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, wanted[columns].astype(str).values))

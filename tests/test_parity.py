"""Every registered query against its SQL, at the smallest scale."""

import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def db():
    return check.open_tables(SF)


@pytest.mark.parametrize("name", list(queries()))
def test_query_agrees_with_sql(spark, db, name):
    verdict, _, _ = check.compare(spark, db, name, queries()[name], ORACLE.get(name), SF)
    assert verdict in ("same", "rows")


def test_entry(spark):
    assert entry(spark).count() == 11

"""Every query with SQL against DuckDB on the small tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle import DATA, compare

pytestmark = pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.001"), reason="no test tables")
SQL = {k: v for k, v in entry.oracle_sql().items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    compare(spark, name, entry.queries()[name], SQL[name], "sf0.001")


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0

"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from catalog.fixture import QUERIES
from tests.oracle import connect, difference


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


# Every query of the catalog has its SQL; others bring their own tests where SQL cannot state them.
def test_catalog_queries_have_sql():
    assert set(QUERIES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_its_sql(spark, sf_dir, con, name):
    frame = queries()[name](spark, sf_dir)
    assert difference(frame, con, oracle_sql()[name]) is None


def test_entry_returns_rows(spark):
    assert entry(spark).count() > 0

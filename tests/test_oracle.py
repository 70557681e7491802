"""Every registered query against the SQL it is checked by."""

import pytest

import oracle
from siftmill.catalog import all_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, connection, name):
    query, sql = all_queries()[name]
    if sql is None:
        query(spark, SF).collect()
        return
    _, problems = oracle.compare(spark, connection, query, sql, SF)
    assert not problems


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import connect, difference

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", list(queries()))
def test_query_equals_its_sql(spark, con, name):
    make = queries()[name]
    if name in SQL:
        assert difference(spark, con, SF, make, SQL[name]) is None
    else:
        assert make(spark, SF).count() > 0

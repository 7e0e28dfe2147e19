"""Every registered query of the library against its SQL, over the smallest tables."""

import pytest

from compare import SMALL, assert_same
from evgraph.plans import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    assert_same(QUERIES[name](spark, SMALL), duck.sql(SQL[name]))


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())

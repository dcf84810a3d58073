import pytest

import __spark_entry__ as entry
from tallyworks.plans import catalog

from .compare import same_rows
from .conftest import DATA, LARGER

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, DATA), duck.sql(SQL[name]))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql_on_a_larger_table(spark, larger_duck, name):
    """Ties and repeated keys that the smallest tables lack."""
    same_rows(QUERIES[name](spark, LARGER), larger_duck.sql(SQL[name]))


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["project_detail"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_orderkey,7)" in plan and "l_comment" not in plan

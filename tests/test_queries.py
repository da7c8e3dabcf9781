"""Every market query with a SQL twin gives the same rows as DuckDB at the smallest scale."""

import compare
import pytest

from tidemark.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def test_twins_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, tiny, name):
    spark.catalog.clearCache()
    columns, rows = compare.spark_rows(QUERIES[name](spark, tiny))
    assert (columns, rows) == compare.duck_rows(compare.duck(tiny), ORACLES[name])


def test_entry_has_rows(spark, tiny):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_price_history_plan(spark, tiny):
    plan = QUERIES["mart_price_history"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan

"""Every registered query against its SQL on the small tables."""

import pytest
from check import rows_of, same_type
from conftest import SF_DIR

import __spark_entry__ as entry

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()
PAIRWISE = ("CartesianProduct", "BroadcastNestedLoopJoin")


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["product_id", "product_name", "poisson_forecast", "stock", "restock_needed", "status"]
    assert frame.limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF_DIR)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in PAIRWISE if node in plan]
    rows = [tuple(row) for row in frame.collect()]
    assert rows
    if name not in ORACLES:
        return
    result = duck.sql(ORACLES[name])
    assert sorted(frame.columns) == sorted(result.columns)
    kinds = dict(zip(result.columns, map(str, result.types)))
    assert all(same_type(frame.schema[c].dataType.simpleString(), kinds[c]) for c in frame.columns)
    assert rows_of(frame.columns, rows) == rows_of(result.columns, result.fetchall())

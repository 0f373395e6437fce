"""Every registered query of the engine against its SQL; those without SQL must run."""

import pytest
from oracle import SF, connection, same

from recollect.plans import jobs, knowledge, learning, memory, registry, reports, retrieval, rules  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, name):
    same(registry.QUERIES[name](spark, SF).toPandas(), connection().execute(registry.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.SQL.keys()))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())

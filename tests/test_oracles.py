"""Every registered query against its DuckDB twin; queries without one must run and return columns."""

import pytest

from lectern.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf_dir, duck, same):
    got = registry.QUERIES[name](spark, sf_dir)
    if name in registry.ORACLES:
        same(got.toPandas(), duck.execute(registry.ORACLES[name]).df())
    else:
        assert got.columns and got.count() > 0


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0

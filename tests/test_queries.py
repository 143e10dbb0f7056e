"""Every query with SQL against DuckDB, on the smallest tables."""

import pytest
from conftest import DATA, same

from trajspark.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    same(QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df(), 5)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).collect()) == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

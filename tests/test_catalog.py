"""Every query that SQL can express, against DuckDB; the others run."""

import pytest
from compare import duck, same

from kagajflow.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_duckdb(spark, data, name):
    same(catalog.queries()[name](spark, data).toPandas(), duck(data).sql(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, data, name):
    assert catalog.queries()[name](spark, data).count() > 0

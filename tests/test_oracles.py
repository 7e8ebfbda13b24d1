"""Every registered query of the library against its DuckDB twin."""

import pytest

from tessera.plans.catalog import ORACLES, QUERIES
from tests import oracle


@pytest.fixture(scope="module")
def con():
    return oracle.connection(oracle.DATA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert oracle.compare(spark, con, oracle.DATA, QUERIES[name], ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, oracle.DATA).count() > 0

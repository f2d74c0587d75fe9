"""Every query with SQL gives the rows of its SQL; those without give rows of a stable schema."""

import pytest

from claimloom import plans
from tests.conftest import DATA

QUERIES, SQL = plans.queries(), plans.sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, duck, same):
    same(QUERIES[name](spark, str(DATA)), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark):
    if not DATA.exists():
        pytest.skip("no test data here")
    assert QUERIES[name](spark, str(DATA)).columns


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())

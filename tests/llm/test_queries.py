import pytest

from claimloom.llm import queries
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(name, spark, duck, same):
    same(queries.QUERIES[name](spark, str(DATA)), duck, queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(name, spark):
    if not DATA.exists():
        pytest.skip("no test data here")
    assert queries.QUERIES[name](spark, str(DATA)).count() > 0

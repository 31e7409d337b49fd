"""Every registered query against its DuckDB statement on the smallest data."""
import pytest

import __spark_entry__ as E
from tests.conftest import SMALL
from tests.oracle_util import compare, duck

QUERIES = E.queries()
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    ok, info = compare(QUERIES[name](spark, SMALL), con, SQL[name])
    assert ok, info


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    assert df.count() > 0

"""Every named query equals its SQL on the smallest tables."""

import re
from concurrent.futures import ThreadPoolExecutor

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from trialspark.session import shared_dir

from .compare import connect, differences

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def outcomes(request, spark, small_dir):
    """The wanted comparisons, run side by side: on tables this small the time goes into planning, not into tasks."""
    db = connect(small_dir)
    shared_dir(spark)
    calls = (item.callspec.params for item in request.session.items if hasattr(item, "callspec"))
    names = sorted({params["query"] for params in calls if "query" in params})
    with ThreadPoolExecutor(6) as pool:
        yield {n: pool.submit(differences, spark, db.cursor(), QUERIES[n], SQL.get(n), small_dir) for n in names}


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)
    assert {q for q in set(QUERIES) - set(SQL) if not re.match(r"op\d+_|pipeline$", q)} == set()


# The queries of the optional subpackage have tests of their own.
@pytest.mark.parametrize("query", sorted(q for q in SQL if not re.match(r"op\d+_|pipeline$", q)))
def test_query_matches_sql(outcomes, query):
    message, _, _ = outcomes[query].result()
    assert message is None, message


def test_entry(spark):
    result = entry(spark)
    assert {"experiment", "bias_source", "contrast_level", "log_bf", "d"} <= set(result.columns)
    assert result.count() > 0

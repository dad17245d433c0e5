"""Every registered query against its SQL twin on the small tables; queries without one must give rows."""

import re

import pytest
from compare import compare, connect

import __spark_entry__ as entry

# The corpus queries have tests of their own, in tests/llm.
QUERIES = {n: q for n, q in entry.queries().items() if n != "pipeline" and not re.match(r"op\d+_", n)}
SQLS = entry.oracle_sql()
EMPTY_AT_SMALLEST = {"J08_search_window_lookup"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, sf, con):
    if name in SQLS:
        found = compare(spark, con, QUERIES[name], SQLS[name], sf)
        # Some filters leave nothing at the smallest scale; both sides must agree on that.
        assert found is None or found == "no rows" and name in EMPTY_AT_SMALLEST
    else:
        assert not QUERIES[name](spark, sf).isEmpty()

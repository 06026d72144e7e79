"""The corpus queries that SQL can express against DuckDB."""

import os

import pytest

from loam.llm import queries
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    oracle.compare(spark, queries.QUERIES[name], queries.ORACLES[name])

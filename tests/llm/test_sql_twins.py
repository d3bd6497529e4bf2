"""The queries that SQL can express give what it gives."""

import pytest
from compare import connection, difference

from orefield.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_gives_what_sql_gives(spark, name):
    assert difference(spark, SF, queries.queries()[name], queries.oracle_sql()[name], connection(SF)) is None

"""Operators with SQL against that SQL."""

import pytest

from orbweave.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(name, spark, data, same_rows):
    same_rows(QUERIES[name](spark, data), ORACLE_SQL[name])

"""Each query with SQL gives the SQL's rows; the others run and have rows."""

import pytest
from oracle import differences

from pageloom.plans import oracle, queries


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_matches_sql(spark, small, tmp_path, name):
    assert differences(queries.queries()[name](spark, small), oracle.SQL[name], small, str(tmp_path / "out")) == ([], [], {})


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracle.SQL)))
def test_query_without_sql_has_rows(spark, small, name):
    assert queries.queries()[name](spark, small).count() > 0

import os

import pytest

from fixturelake.llm import queries as q
from tests.oracle_check import compare, views


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, data, name):
    if not os.path.isdir(data):
        pytest.skip("no data")
    df = q.queries()[name](spark, data)
    sql = q.oracle_sql().get(name)
    if sql:
        compare(df, views(data), sql)
    else:
        # these have no SQL: each operator has tests of its own against brute force, round trips or planted cases
        rows = df.collect()
        assert rows and len(set(df.columns)) == len(df.columns) and len(set(map(repr, rows))) == len(rows)

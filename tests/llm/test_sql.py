"""The operators that SQL can express give the rows that DuckDB gives."""

import pytest

from tests.conftest import DATA, rows_of
from vectide.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, f"{DATA}/sf0.01").toPandas()
    want = duck("sf0.01").execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert rows_of(got.astype(object).where(got.notna(), None))[1] == rows_of(want.astype(object).where(want.notna(), None))[1]

"""Every query that has SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from tests.conftest import DATA, rows_of
from vectide.plans import registry as queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, f"{DATA}/sf0.01").toPandas()
    want = duck("sf0.01").execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    (_, a), (_, b) = rows_of(got), rows_of(want)
    assert len(a) == len(b)
    if name == "positional_zip":  # the order of the file is its id order
        assert [x[-1] for x in a] == [x[-1] for x in b]
    assert a == b


def in_files(spark, path, ids):
    """A folder of vectors in files of these ids; the last ids are in the largest file, which Spark reads first."""
    at = f"{path}/embeddings.parquet"
    for own in ids:
        spark.createDataFrame([(i, [1.0, 2.0], 0) for i in own], "vec_id long, embedding array<float>, label int").coalesce(1).write.mode("append").parquet(at)
    return duckdb.connect().execute(f"CREATE VIEW embeddings AS SELECT * FROM '{at}/*.parquet'")


@pytest.mark.parametrize("ids", [[range(40), range(40, 2000)], [[5, None, 3], [None, 5, *range(100, 1000)], [-7]], [[]]])
def test_table_order_of_files(spark, tmp_path, ids):
    con = in_files(spark, tmp_path, ids)
    got = queries.QUERIES["table_order"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got if r.vec_id is not None) == sorted(x for x in con.execute(queries.SQL["table_order"]).fetchall() if x[1] is not None)
    assert sorted(r.place for r in got) == list(range(sum(map(len, ids))))


@pytest.mark.parametrize("ids", [[range(1234)], [range(150), [None, 7, 7], range(200, 1000)], [range(37)], [[None]], [[]]])
def test_batches_mapped_of_any_number_of_rows(spark, tmp_path, ids):
    con = in_files(spark, tmp_path, ids)
    got = queries.QUERIES["batches_mapped"](spark, str(tmp_path)).select("batches", "least", "most", "ids").collect()
    assert [tuple(r) for r in got] == con.execute(queries.SQL["batches_mapped"]).fetchall()


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


def test_entry_registers_all(spark):
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 10

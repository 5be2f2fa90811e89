import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vectide.operators import rows as R


def test_row_ids_follow_partitions(spark):
    df = spark.range(0, 1000, 1, 7)
    assert [(r.id, r[R.ROW_ID]) for r in R.with_row_id(df).orderBy("id").collect()] == [(i, i) for i in range(1000)]


def test_union_is_strict(spark):
    a = spark.createDataFrame([(1, 2.0)], "x int, y double")
    assert R.union_all(a) is a
    assert R.union_all(a, a).count() == 2
    for schema, row in (("y double, x int", (2.0, 1)), ("x int", (1,)), ("x long, y double", (1, 2.0))):
        with pytest.raises(ValueError, match="schemas differ"):
            R.union_all(a, spark.createDataFrame([row], schema))


def test_zip_takes_the_last_of_a_name(spark):
    a = spark.range(0, 10, 1, 3).withColumn("v", F.lit("a"))
    b = spark.range(10, 20, 1, 2).select(F.col("id").alias("w"), F.lit("b").alias("v"))
    z = R.zip_columns(a, b)
    assert z.columns == ["id", "v", "w"]
    assert sorted((r.id, r.v, r.w) for r in z.collect()) == [(i, "b", i + 10) for i in range(10)]
    with pytest.raises(ValueError, match="unequal"):
        R.zip_columns(a, spark.range(3))
    with pytest.raises(ValueError, match="axis"):
        R.concat(a, b, axis=2)


def test_positions_are_a_permutation(spark):
    df = spark.range(500)
    a = R.random_positions(df, 1, chunks=7).orderBy("id").collect()
    assert sorted(r["__POS__"] for r in a) == list(range(500))
    assert a == R.random_positions(df, 1, chunks=7).orderBy("id").collect()
    assert a != R.random_positions(df, 2, chunks=7).orderBy("id").collect()


def test_batches_drop_the_remainder(spark):
    b = R.random_batches(spark.range(105), 10, seed=3)
    assert sorted(r["count"] for r in b.groupBy("batch_id").count().collect()) == [10] * 10
    assert b.select("id").distinct().count() == 100
    with pytest.raises(ValueError):
        R.random_batches(spark.range(3), 10)


def test_batches_keep_the_rest_if_asked(spark):
    b = R.random_batches(spark.range(105), 10, seed=3, rest=True)
    assert [r["count"] for r in b.groupBy("batch_id").count().orderBy("batch_id").collect()] == [10] * 10 + [5]
    assert b.select("id").distinct().count() == 105
    assert R.random_batches(spark.range(3), 10, rest=True).count() == 3
    sizes = R.map_batches(spark.range(25), 10, lambda t: pa.table({"n": [t.num_rows]}), "n long", rest=True).collect()
    assert sorted(r.n for r in sizes) == [5, 10, 10]


def test_map_batches_runs_each_row_once(spark):
    def add(t):
        ids = t.column("id").to_pylist()
        assert ids == sorted(ids)  # scan order
        return pa.table({"total": [sum(ids)], "n": [len(ids)]})

    out = R.map_batches(spark.range(100), 20, add, "total long, n long").collect()
    assert [r.n for r in out] == [20] * 5 and sum(r.total for r in out) == 4950


def test_iterated_batches(spark):
    got = list(R.iter_batches(spark.range(50), 20, seed=1))
    assert [t.num_rows for t in got] == [20, 20] and len({x for t in got for x in t.column("id").to_pylist()}) == 40


def test_sample_in_scan_order(spark):
    ids = [r.id for r in R.sample_rows(spark.range(100), 10, 1).collect()]
    assert len(set(ids)) == 10 and ids == sorted(ids)


def test_many_queries(spark):
    from vectide.functions.metrics import numpy_distance
    from vectide.plans.search import search_many

    rng = np.random.default_rng(0)
    rows, qs = rng.normal(size=(200, 4)), rng.normal(size=(5, 4))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)] + [(200, None)], "id long, v array<double>").repartition(5)
    queries = spark.createDataFrame([(i * 10, q.tolist()) for i, q in enumerate(qs)], "query_id int, target array<double>")
    got = search_many(df, "v", queries, "cosine", 3, "id").collect()
    want = numpy_distance("cosine", rows, qs)
    assert sorted((r.query_id, r["rank"], r.id) for r in got) == sorted((j * 10, k + 1, int(i)) for j in range(5) for k, i in enumerate(np.argsort(want[:, j])[:3]))
    with pytest.raises(ValueError):
        search_many(df, "v", queries, "l2", 3, "id", most=2)

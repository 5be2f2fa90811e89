import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectide.functions import metrics as M
from vectide.plans.search import search

ROWS = [(0, [1.0, 2.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0]), (5, [1.0, 2.0]), (6, [None, 1.0])]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(ROWS, "id long, v array<float>").cache()


@pytest.mark.parametrize(("metric", "want"), [("l2", 2.0), ("euclidean", 2.0), ("dot", -1.0), ("inner_product", -1.0), ("cosine", 0.5 - 0.5 / math.sqrt(5))])
def test_hand_computed(spark, edges, metric, want):
    row = edges.filter("id = 0").select(M.distance(metric, F.col("v"), [1, 0]).alias("a"), M.arrow_distance(metric, F.col("v"), [1, 0]).alias("b"))
    row = row.crossJoin(edges.filter("id = 0").select(M.pair_distance(metric, F.col("v"), M.literal([1, 0])).alias("c"))).first()
    assert row.a == pytest.approx(want) and row.b == pytest.approx(want) and row.c == pytest.approx(want)


def test_zero_vector_is_halfway(edges):
    assert edges.filter("id = 1").select(M.distance("cosine", F.col("v"), [1, 0])).first()[0] == 0.5


@pytest.mark.parametrize("kernel", [M.distance, M.arrow_distance])
def test_unusable_vectors(edges, kernel):
    got = {r.id: r.d for r in edges.select("id", kernel("l2", F.col("v"), [1, 0]).alias("d")).collect()}
    assert got[2] is None and got[4] is None and got[6] is None and math.isnan(got[3])


def test_unknown_metric():
    with pytest.raises(ValueError, match="unknown metric"):
        M.canonical("manhattan")


def test_long_vectors_use_array_functions(spark):
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(5, 200))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id int, v array<double>")
    q = rng.normal(size=200)
    for m in ("l2", "dot", "cosine"):
        got = [r.d for r in df.select("id", M.distance(m, F.col("v"), q).alias("d")).orderBy("id").collect()]
        assert np.allclose(got, M.numpy_distance(m, rows, q)[:, 0])


def test_top_k_drops_null_and_nan_only_when_asked(edges):
    assert search(edges, "v", [1, 0], "l2").count() == len(ROWS)
    near = search(edges, "v", [1, 0], "l2", maxval=5, tie="id").collect()
    assert [r.id for r in near] == [1, 0, 5]


def test_ties_by_id_and_element_type(edges):
    near = search(edges, "v", [1, 2], "l2", maxval=2, tie="id")
    assert [r.id for r in near.collect()] == [0, 5]
    assert dict(near.dtypes)["__DISTANCE__"] == "float"


def test_selected_distance_is_not_repeated(edges):
    assert search(edges, "v", [1, 0], "l2", select=["id", "__DISTANCE__"], maxval=1).columns == ["id", "__DISTANCE__"]


@pytest.mark.parametrize("bad", [[1.0], [[1.0, 2.0], [3.0, 4.0]], []])
def test_wrong_queries(edges, bad):
    with pytest.raises(ValueError):
        search(edges, "v", bad, "l2", dim=2)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.floats(-5, 5, width=32), min_size=3, max_size=3), min_size=1, max_size=8), st.integers(1, 6))
def test_filter_then_search_is_search_of_filtered(spark, rows, k):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, v array<float>")
    a = search(df, "v", [1, 2, 3], "l2", filter="id % 2 = 0", maxval=k, tie="id").collect()
    b = search(df.filter("id % 2 = 0"), "v", [1, 2, 3], "l2", maxval=k, tie="id").collect()
    assert a == b
    d = M.numpy_distance("l2", np.array([r for i, r in enumerate(rows) if i % 2 == 0]), np.array([1, 2, 3.0]))[:, 0]
    assert np.allclose([r["__DISTANCE__"] for r in a], np.sort(d)[:k], atol=1e-4)

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectide.functions.metrics import METRICS, numpy_distance
from vectide.operators import coder as C
from vectide.plans.search import CODE, search


def coding(n, k, dim, metric="l2", seed=0):
    return C.Coding(np.random.default_rng(seed).normal(size=(n, k, dim)), C.CoderConfig(metric=metric, codebook_size=k, num_codebooks=n))


def table_costs(own, q):
    """All k**n costs, book 0 the most significant digit."""
    return np.array([sum(own.costs(q)[j, s] for j, s in enumerate(slots)) for slots in itertools.product(range(own.config.codebook_size), repeat=own.config.num_codebooks)])


@pytest.mark.parametrize(("n", "k", "digits", "code"), [(2, 8, (3, 5), 29), (3, 2, (1, 0, 1), 5)])
def test_mixed_radix(n, k, digits, code):
    own = coding(n, k, 2)
    assert sum(w * d for w, d in zip(own._weights(), digits, strict=True)) == code


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3), st.integers(1, 4), st.integers(0, 10_000), st.sampled_from(sorted(METRICS)))
def test_row_code_is_the_cheapest_of_all(n, k, seed, metric):
    own = coding(n, k, 3, metric, seed)
    q = np.random.default_rng(seed + 1).normal(size=3)
    costs = table_costs(own, q)
    assert own.encode_numpy(q[None])[0] == costs.argmin()
    assert own.ranked(q) == np.lexsort((np.arange(len(costs)), costs)).tolist()


def test_traversal_equals_enumeration(monkeypatch):
    own, q = coding(3, 5, 4), np.ones(4)
    want = own.ranked(q, 40)
    monkeypatch.setattr(C, "ENUMERATED", 1)
    assert own.ranked(q, 40) == want
    assert sorted(own.ranked(q)) == list(range(125))


@pytest.mark.parametrize("metric", sorted(METRICS))
def test_column_codes_equal_numpy(spark, monkeypatch, metric):
    own = coding(2, 4, 3, metric)
    rows = np.random.default_rng(3).normal(size=(40, 3))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)] + [(40, None), (41, [1.0])], "id int, v array<double>")
    want = [*own.encode_numpy(rows).tolist(), None, None]
    assert [r.c for r in df.select("id", own.code(F.col("v")).alias("c")).orderBy("id").collect()] == want
    monkeypatch.setattr(C, "LITERALS", 0)
    assert [r.c for r in df.select("id", own.code(F.col("v")).alias("c")).orderBy("id").collect()] == want
    first = [r.c and r.c[:2] for r in df.select("id", own.codes(F.col("v"), 2).alias("c")).orderBy("id").collect()]
    assert first == [own.ranked(r, 2) for r in rows] + [None, None]


def test_call_answers_in_kind():
    import pyarrow as pa

    own = coding(2, 3, 2)
    assert isinstance(C.call([1.0, 2.0], own, 2), np.ndarray)
    assert C.call(pa.array([[1.0, 2.0], None]), own, 2).to_pylist() == [own.ranked([1, 2], 2), None]


def test_hand_computed_update():
    new = C.update("l2", np.array([[0.0, 0], [10, 10]]), np.array([[2.0, 0], [4, 0], [9, 9]]))
    assert new.tolist() == [[2, 0], [9.5, 9.5]]
    assert C.update("l2", np.array([[0.0, 0], [50, 50]]), np.array([[2.0, 0]])).tolist() == [[1, 0], [50, 50]]


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_frame_update_equals_numpy(spark, metric):
    own = coding(2, 3, 2, metric)
    rows = np.random.default_rng(5).normal(size=(30, 2))
    df = spark.createDataFrame([(r.tolist(),) for r in rows], "v array<double>")
    got = {(r.book, r.slot): r for r in C.centroid_update(df, "v", own).collect()}
    for j, book in enumerate(own.books):
        want = C.update(metric, book, rows)
        members = np.bincount(numpy_distance(metric, rows, book).argmin(1), minlength=3)
        for s in range(3):
            if metric != "cosine":  # cosine assigns by unit vectors, the same nearest ones
                assert got[j, s].members == members[s]
            assert np.allclose(got[j, s].centroid, want[s])


def test_training_is_seeded_and_checked(spark):
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.normal(c * 10, 1, size=(30, 2)) for c in range(4)])
    df = spark.createDataFrame([(r.tolist(),) for r in rows], "v array<double>")
    config = C.CoderConfig("l2", 4, 2, 20, 3, seed=9)
    a, b = C.train(df, "v", config), C.train(df, "v", config)
    assert np.array_equal(a.books, b.books) and a.books.shape == (2, 4, 2)
    with pytest.raises(ValueError):
        C.train(df, "v", C.CoderConfig("l2", 100, 2, 1, 1))
    with pytest.raises(ValueError):
        C.train(df, "v", C.CoderConfig("l2", 4, 2, 100, 1))
    raw = C.train(df, "v", C.CoderConfig("l2", 4, 2, 1000, 0))
    assert all(any(np.allclose(c, r) for r in rows) for c in raw.books.reshape(-1, 2))


def test_all_probes_equal_exact(spark):
    own = coding(2, 3, 4)
    rows = np.random.default_rng(8).normal(size=(60, 4))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id int, v array<double>").withColumn(CODE, own.code(F.col("v")))
    q = [0.1, 0.2, 0.3, 0.4]
    exact = search(df, "v", q, "l2", maxval=7, tie="id").collect()
    assert search(df, "v", q, None, coding=own, probes=9, maxval=7, tie="id").collect() == exact
    assert search(df, "v", q, None, coding=own, probes=99, maxval=7, tie="id").collect() == exact
    few = search(df, "v", q, "dot", coding=own, probes=1)
    assert {r[CODE] for r in few.collect()} <= {own.ranked(q, 1)[0]}

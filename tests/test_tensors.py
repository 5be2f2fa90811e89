import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp

from vectide.operators import nested as N
from vectide.operators import tensors as T
from vectide.operators.rows import ROW_ID


@pytest.mark.parametrize("dtype", ["float32", "float64", "int64", "int32", "uint8", "float16"])
def test_round_trip(spark, tmp_path, dtype):
    a = np.arange(24).reshape(4, 2, 3).astype(dtype)
    df = T.from_numpy(spark, "t", a, **{ROW_ID: np.arange(4)})
    df.write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert T.TensorType.of(back.schema["t"]).shape == (2, 3)
    assert np.array_equal(T.to_numpy(back, "t"), a)
    assert back.filter(T.valid(back, "t")).count() == 4


def test_scalars(spark):
    a = np.array([[1.5, 2.0], [3.0, 4.0]], np.float32)
    df = T.from_numpy(spark, "t", a[None])
    row = df.first().t
    assert np.array_equal(T.scalar_to_numpy(row, df.schema["t"]), a)
    assert spark.range(1).select(T.scalar(a).alias("s")).first().s == a.ravel().tolist()
    with pytest.raises(ValueError):
        T.to_numpy(spark.range(2), "id")


def test_quantize_by_hand(spark):
    a = np.array([[-1, 0, 1, 2]], np.float32)
    q = T.quantize(T.from_numpy(spark, "t", a), "t")
    meta = q.schema["t"].metadata
    assert meta["scale"] == pytest.approx(3 / 127) and meta["shift"] == 42
    assert q.first().t == [0, 42, 84, 127]
    assert T.dequantize(q, "t").first().t == pytest.approx([-0.992126, 0, 0.992126, 2.007874], abs=1e-6)
    assert T.quantize(q, "t") is q
    with pytest.raises(ValueError):
        T.dequantize(T.dequantize(q, "t"), "t")


def test_halves_round_to_even(spark):
    a = np.array([[0.0, 0.5, 1.5, 2.5, 127.0]], np.float32)
    assert T.quantize(T.from_numpy(spark, "t", a), "t").first().t == [0, 0, 2, 2, 127]
    assert np.asarray(T.quantize_numpy(a)).tolist() == [[0, 0, 2, 2, 127]]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(hnp.arrays(np.float32, (3, 4), elements=st.floats(-100, 100, width=32)))
def test_quantized_values_are_near(spark, a):
    q = T.quantize_numpy(a)
    assert np.abs(q.dequantize() - a).max() <= q.scale * 1.01 + 1e-6
    df = T.quantize(T.from_numpy(spark, "t", a, **{ROW_ID: np.arange(3)}), "t")
    got = T.quantized_to_numpy(df, "t")
    assert np.array_equal(np.asarray(got), np.asarray(q)) and got.shift == q.shift and got[1:].scale == q.scale


def test_quantized_round_trip(spark):
    q = T.quantize_numpy(np.array([[1.0, 2.0], [3.0, -4.0]], np.float32))
    df = T.quantized_from_numpy(spark, "t", q, **{ROW_ID: np.arange(2)})
    back = T.quantized_to_numpy(df, "t")
    assert np.array_equal(np.asarray(back), np.asarray(q)) and (back.scale, back.shift) == (q.scale, q.shift)
    one = T.quantized_scalar(df.orderBy(ROW_ID).first().t, df.schema["t"])
    assert np.allclose(one.dequantize(), q[0].dequantize())


def test_nested(spark, tmp_path):
    values = {"a": np.arange(6.0).reshape(3, 2), "b": {"c": np.arange(12, dtype=np.int32).reshape(3, 2, 2)}}
    df = N.from_numpy(spark, "n", values)
    df.write.parquet(str(tmp_path / "n"))
    back = spark.read.parquet(str(tmp_path / "n"))
    assert N.shapes(back.schema["n"].dataType) == {"a": (2,), "b": {"c": (2, 2)}}
    got = N.to_numpy(df, "n")
    assert np.array_equal(got["a"], values["a"]) and np.array_equal(got["b"]["c"], values["b"]["c"])
    leaf = N.to_field(df, "n", "b", "c")
    assert np.array_equal(T.to_numpy(leaf, "c"), values["b"]["c"])
    inner = N.to_field(df, "n", "b")
    assert np.array_equal(N.to_numpy(inner, "b")["c"], values["b"]["c"])
    plan = N.to_field(back, "n", "b", "c")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<n:struct<b:struct<c:array<int>>>>" in plan
    one = N.scalar_to_numpy(df.first().n, df.schema["n"].dataType)
    assert one["b"]["c"].shape == (2, 2)
    with pytest.raises(ValueError):
        N.to_field(df, "n", "b", "x")
    with pytest.raises(ValueError):
        N.from_numpy(spark, "n", {"a": np.zeros(2), "b": np.zeros(3)})

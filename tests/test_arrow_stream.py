import numpy as np
import pyarrow as pa
import pytest

from vectide.sources import arrow_stream as A
from vectide.streaming.transport import record_batches


def sample():
    vector = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(20, dtype=np.float32)), 4)
    return pa.table({"id": pa.array(range(5)), "v": vector, "u": pa.array([1, 2, 3, 4, None], pa.uint8()), "s": pa.array(["a", None, "c", "d", "e"])})


def test_save_and_load(tmp_path):
    path = str(tmp_path / "x" / "t.arrow")
    assert A.save_stream(path, sample().to_reader(2)).equals(sample())
    with pytest.raises(ValueError):
        A.save_stream(str(tmp_path / "t.bin"), sample().to_reader())


def test_data_source(spark, tmp_path):
    spark.dataSource.register(A.ArrowStream)
    A.save_stream(str(tmp_path / "in.arrow"), sample().to_reader(2))
    df = spark.read.format("arrow_stream").load(str(tmp_path / "in.arrow"))
    assert dict(df.dtypes) == {"id": "bigint", "v": "array<float>", "u": "smallint", "s": "string"}
    rows = sorted(df.collect(), key=lambda r: r.id)
    assert rows[1].v == [4, 5, 6, 7] and rows[4].u is None and rows[1].s is None
    out = str(tmp_path / "out")
    df.repartition(2).write.format("arrow_stream").mode("append").save(out)
    again = spark.read.format("arrow_stream").load(out)
    assert sorted(again.collect(), key=lambda r: r.id) == rows
    df.limit(2).write.format("arrow_stream").mode("overwrite").save(out)
    assert spark.read.format("arrow_stream").load(out).count() == 2


def test_result_batches(spark):
    batches = list(record_batches(spark.range(0, 100, 1, 4)))
    assert pa.Table.from_batches(batches).column("id").to_pylist() == list(range(100))

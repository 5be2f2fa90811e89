import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vectide.engine import Engine
from vectide.functions.metrics import METRICS, numpy_distance
from vectide.operators.coder import CoderConfig
from vectide.sources.catalog import Catalog, StaleIndex

N, DIM = 2000, 16
CONFIG = {"codebook_size": 4, "num_codebooks": 2, "batch_size": 200, "num_epochs": 2}


def clusters(seed=0, n=N):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(20, DIM)) * 10
    return (centers[np.arange(n) % 20] + rng.normal(size=(n, DIM))).astype(np.float32)


def arrow(rows):
    vector = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), DIM)
    return pa.table({"id": pa.array(np.arange(len(rows))), "vector": vector})


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("root") / "db"))
    e.make_table("test/table", arrow(clusters()).to_reader(100))
    return e


def test_put_and_get_in_order(engine):
    got = engine.read_table("test/table", ordered=True)
    assert got.columns == ["id", "vector"]
    t = got.toArrow()
    assert t.column("id").to_pylist() == list(range(N))
    assert np.array_equal(np.array(t.column("vector").to_pylist(), np.float32), clusters())


def test_a_sorted_frame_keeps_its_order(engine):
    """Its partitions may differ from run to run: with all columns there are more of them than for a count."""
    pad = F.concat(*(F.sha2(F.concat_ws("-", "id", F.lit(k)), 256) for k in range(6)))
    df = engine.spark.range(0, 50_000, 1, 9).select("id", F.xxhash64("id").alias("key"), pad.alias("pad"))
    got = engine.make_table("sorted", df.orderBy("key")).catalog.table("sorted", ordinal=True).orderBy("__ROW_ID__").collect()
    engine.drop_table("sorted")
    assert [r["__ROW_ID__"] for r in got] == list(range(50_000))
    assert [r.key for r in got] == sorted(r.key for r in got)


def test_a_table_of_several_frames_keeps_their_order(engine):
    """Also with frames of empty partitions and without rows."""
    spark = engine.spark
    frames = [spark.range(0, 100, 1, 7).filter("id % 50 > 20"), spark.range(0), spark.range(0, 30, 1, 3).orderBy(F.desc("id"))]
    engine.catalog.make_table_of("several", iter(frames))
    got = engine.read_table("several", ordered=True).collect()
    assert [r.id for r in got] == [*(i for i in range(100) if i % 50 > 20), *reversed(range(30))]
    assert sorted(r["__ROW_ID__"] for r in engine.catalog.table("several", ordinal=True).collect()) == list(range(len(got)))
    engine.drop_table("several")


def test_select_and_filter(engine):
    got = engine.read_table("test/table", select=["id"], filter="id < 5 and size(vector) = 16")
    assert got.columns == ["id"] and sorted(r.id for r in got.collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(Exception):
        engine.read_table("test/table", select=["nothing"])


def test_several_sources(engine):
    engine.make_table("more", arrow(clusters(1, 100)))
    assert engine.read_table(["test/table", "more"]).count() == N + 100
    engine.make_table("other", engine.spark.range(3))
    with pytest.raises(ValueError, match="schemas differ"):
        engine.read_table(["more", "other"])
    engine.drop_table("other").drop_table("other")
    assert "other" not in engine.tables() and {"more", "test/table"} <= set(engine.tables())


@pytest.mark.parametrize("metric", sorted(METRICS))
def test_exact_search(engine, metric):
    q = np.random.default_rng(4).normal(size=DIM)
    got = engine.search(q, "test/table", "vector", metric, maxval=10)
    assert got.columns == ["id", "vector", "__DISTANCE__"] and dict(got.dtypes)["__DISTANCE__"] == "float"
    d = numpy_distance(metric, clusters(), q)[:, 0]
    assert [r.id for r in got.collect()] == np.argsort(d, kind="stable")[:10].tolist()


@pytest.mark.parametrize("metric", sorted(METRICS))
def test_index_and_approximate_search(engine, metric):
    name = f"coding/{metric}"
    assert engine.make_index(name, "test/table", "vector", CONFIG | {"metric": metric}) is engine
    rows = engine.read_table("test/table", name, "vector")
    assert rows.columns == ["id", "vector", "__CODED_ID__"] and dict(rows.dtypes)["__CODED_ID__"] == "bigint"
    own = engine.catalog.coding(name)
    by_id = {r.id: r["__CODED_ID__"] for r in rows.collect()}
    want = own.encode_numpy(clusters().astype(np.float64))
    assert [by_id[i] for i in range(N)] == want.tolist()
    q = clusters()[7]
    got = engine.search(q, "test/table", "vector", metric, coding=name, maxval=10, probes=8)
    assert got.columns == ["id", "vector", "__CODED_ID__", "__DISTANCE__"]
    assert {r["__CODED_ID__"] for r in got.collect()} <= set(own.ranked(q, 8))
    assert "PartitionFilters: [" in got._jdf.queryExecution().executedPlan().toString() and "__CELL__" in got._jdf.queryExecution().executedPlan().toString()
    everything = engine.search(q, "test/table", "vector", metric, coding=name, maxval=10, probes=16, select=["id"]).collect()
    assert everything == engine.search(q, "test/table", "vector", metric, maxval=10, select=["id"]).collect()
    shown = engine.search(q, "test/table", "vector", metric, coding=name, maxval=3)
    assert "__CODED_ID__" in shown.columns


def test_filter_by_code(engine):
    engine.make_index("f", "test/table", "vector", CoderConfig("l2", 4, 2, 100, 1))
    assert engine.read_table("test/table", "f", "vector", select=["id"], filter=F.col("__CODED_ID__") >= 0).count() == N


def test_index_goes_stale(engine):
    engine.make_table("s", arrow(clusters(2, 500)))
    engine.make_index("stale", ["s"], "vector", CoderConfig("l2", 2, 2, 50, 1))
    engine.make_table("s", arrow(clusters(3, 500)))
    with pytest.raises(StaleIndex):
        engine.read_table("s", "stale", "vector")
    engine.sync_index("stale", "s", "vector")
    assert engine.read_table("s", "stale", "vector").count() == 500
    engine.make_index("stale2", "s", "vector", CoderConfig("l2", 2, 2, 50, 1))
    engine.drop_index("stale")
    assert ("s", "vector", "stale2") in engine.indexes() and ("s", "vector", "stale") not in engine.indexes()
    assert "stale" not in engine.codings()
    engine.drop_table("s")
    assert all(i[0] != "s" for i in engine.indexes())


def test_streams_are_written_in_parts(engine, monkeypatch):
    from vectide.sources import arrow_stream

    monkeypatch.setattr(arrow_stream, "STREAM_BYTES", 20000)
    engine.make_table("stream", arrow(clusters(5, 900)).to_reader(100))
    got = engine.read_table("stream", ordered=True).toArrow()
    assert got.column("id").to_pylist() == list(range(900)) and np.array_equal(np.array(got.column("vector").to_pylist(), np.float32), clusters(5, 900))
    empty = arrow(clusters(5, 0)).to_reader()
    assert engine.make_table("stream", empty).read_table("stream").count() == 0
    engine.drop_table("stream")


def test_tables_do_not_lie_in_tables(engine):
    engine.make_table("up/down", engine.spark.range(2))
    for name in ("up", "up/down/more"):
        with pytest.raises(ValueError, match="tables|table"):
            engine.make_table(name, engine.spark.range(1))
    assert engine.read_table("up/down").count() == 2 and "up/down" in engine.tables()
    engine.drop_table("up/down")


def test_planned_frames_outlive_a_replacement(engine):
    engine.make_table("v", engine.spark.range(3))
    old = engine.read_table("v")
    engine.make_table("v", engine.spark.range(5))
    assert old.count() == 3 and engine.read_table("v").count() == 5
    engine.make_table("v", engine.spark.range(7))
    versions = [c for c, folder in engine.catalog.store.children("sources/v") if folder]
    assert len(versions) == 2 and engine.read_table("v").count() == 7
    engine.drop_table("v")


@pytest.mark.parametrize("name", ["", "a:b", "/a", "a/", "../a", "_x", "a//b", 3])
def test_invalid_names(engine, name):
    with pytest.raises(ValueError):
        engine.make_table(name, engine.spark.range(1))


def test_errors_are_raised_at_once(engine):
    with pytest.raises(ValueError):
        engine.read_table("missing")
    with pytest.raises(ValueError):
        engine.make_index("x", "test/table", "vector", {"metric": "none"})
    with pytest.raises(ValueError):
        engine.search([1.0, 2.0], "test/table", "vector", "l2")
    with pytest.raises(ValueError):
        engine.search(clusters()[0], "test/table", "vector", "nope")
    with pytest.raises(ValueError):
        engine.search(clusters()[0], "test/table", "vector")


def test_frames_can_be_searched(engine):
    df = engine.read_table("test/table")
    assert engine.search(clusters()[3], df, "vector", "l2", maxval=1).first().id == 3


def test_remove(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "gone"))
    e.make_table("t", spark.range(2)).remove()
    assert not (tmp_path / "gone").exists()
    (tmp_path / "plain").mkdir()
    c = Catalog.__new__(Catalog)
    from vectide.sources.storage import Storage

    c.spark, c.store = spark, Storage(spark, str(tmp_path / "plain"))
    with pytest.raises(ValueError):
        c.purge()

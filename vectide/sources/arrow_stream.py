"""Arrow IPC stream files as a Spark data source, read and written batch by batch.

    spark.dataSource.register(ArrowStream)
    spark.read.format("arrow_stream").load("/data/table.arrow")
    df.write.format("arrow_stream").mode("append").save("/data/out")
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema

SUFFIX = ".arrow"


def spark_type(t: pa.DataType) -> pa.DataType:
    """The nearest type that Spark takes: fixed-size lists become lists, uint8 short, other unsigned the next wider, half floats floats."""
    if pa.types.is_fixed_size_list(t) or pa.types.is_list(t) or pa.types.is_large_list(t):
        return pa.list_(spark_type(t.value_type))
    if pa.types.is_struct(t):
        return pa.struct([pa.field(f.name, spark_type(f.type), f.nullable) for f in t])
    if pa.types.is_map(t):
        return pa.map_(spark_type(t.key_type), spark_type(t.item_type))
    wider = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0), pa.float16(): pa.float32()}
    if isinstance(t, pa.ExtensionType):
        return spark_type(t.storage_type)
    return wider.get(t, t)


def spark_schema(schema: pa.Schema) -> pa.Schema:
    return pa.schema([pa.field(f.name, spark_type(f.type), f.nullable) for f in schema])


def to_spark_batch(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(batch.columns, schema, strict=True)], schema=schema)


def files_of(path: str) -> list[str]:
    if os.path.isdir(path):
        return sorted(os.path.join(path, n) for n in os.listdir(path) if n.endswith(SUFFIX))
    return [path]


@dataclass
class _Part(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self):
        return [_Part(p) for p in files_of(self.path)]

    def read(self, partition):
        with pa.memory_map(partition.path) as source, pa.ipc.open_stream(source) as stream:
            schema = spark_schema(stream.schema)
            for batch in stream:
                yield to_spark_batch(batch, schema)


@dataclass
class _Done(WriterCommitMessage):
    new: str
    name: str


class _Writer(DataSourceArrowWriter):
    """A file per task, renamed to its name when the job commits; with overwrite the old files go then."""

    def __init__(self, path: str, overwrite: bool, schema) -> None:
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path, self.overwrite = path, overwrite
        self.schema = to_arrow_schema(schema)

    def write(self, iterator):
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        name = os.path.join(self.path, f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}{SUFFIX}")
        new = f"{name}.new"
        with pa.OSFile(new, "wb") as sink, pa.ipc.new_stream(sink, self.schema) as out:
            for batch in iterator:
                out.write_batch(batch.cast(self.schema) if batch.schema != self.schema else batch)
        return _Done(new, name)

    def commit(self, messages):
        if self.overwrite:
            for old in files_of(self.path):
                os.unlink(old)
        for m in messages:
            os.replace(m.new, m.name)

    def abort(self, messages):
        for m in messages:
            if m is not None and os.path.exists(m.new):
                os.unlink(m.new)


class ArrowStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_stream"

    def schema(self):
        with pa.memory_map(files_of(self.options["path"])[0]) as source, pa.ipc.open_stream(source) as stream:
            return from_arrow_schema(spark_schema(stream.schema))

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite, schema)


def save_stream(path: str, reader: pa.RecordBatchReader) -> pa.Table:
    """Write a reader's batches to one stream file and return what it holds."""
    if not path.endswith(SUFFIX):
        raise ValueError(f"the path must end in {SUFFIX}")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    new = f"{path}.new"
    with pa.OSFile(new, "wb") as sink, pa.ipc.new_stream(sink, reader.schema) as out:
        for batch in reader:
            out.write_batch(batch)
    os.replace(new, path)
    return load_stream(path)


def load_stream(path: str) -> pa.Table:
    with pa.memory_map(path) as source, pa.ipc.open_stream(source) as stream:
        return stream.read_all()


def to_frame(spark, table: pa.Table | pa.RecordBatchReader):
    """A frame from Arrow data of any types that Spark can hold, in its order."""
    if isinstance(table, pa.RecordBatchReader):
        table = table.read_all()
    table = table.cast(spark_schema(table.schema))
    if not table.num_rows:  # without a chunk the columns have no type
        table = pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array([], f.type) for f in table.schema], schema=table.schema)])
    return spark.createDataFrame(table)


#: Bytes of a stream that the driver holds at once.
STREAM_BYTES = 64 << 20


def to_frames(spark, stream: pa.RecordBatchReader, most: int = 0):
    """Frames of a stream's batches, in order, each of about ``most`` bytes (STREAM_BYTES), so that no more is held."""
    held, total, none = [], 0, True
    for batch in stream:
        held.append(batch)
        total += batch.nbytes
        if total >= (most or STREAM_BYTES):
            yield to_frame(spark, pa.Table.from_batches(held))
            held, total, none = [], 0, False
    if held or none:
        yield to_frame(spark, pa.Table.from_batches(held, stream.schema))

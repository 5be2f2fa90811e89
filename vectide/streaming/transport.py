"""Results as a stream of record batches, a partition at a time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame


def record_batches(df: DataFrame) -> Iterator:
    """Arrow record batches of a frame, in its order; the driver holds one chunk at a time."""
    import pyarrow as pa

    def packed(batches):
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["ipc"])

    for row in df.mapInArrow(packed, "ipc binary").toLocalIterator():
        with pa.ipc.open_stream(row.ipc) as r:
            yield from r

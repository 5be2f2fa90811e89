"""Shared pieces: scratch tables in the shared folder, whole-table readers, distributed numbering and components."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one numbered chunk should hold, and the most chunks that are ever made.
CHUNK_ROWS, MOST_CHUNKS = 4096, 65536


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where that is unset in a local session (tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = getattr(shared_dir, "own", None)
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="vectide-")
            shared_dir.own = found
            sc.setCheckpointDir(found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of few rows, so that long texts do not fill a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of frames that nothing refers to any more; else they stay until the driver
    happens to collect its garbage."""
    for _ in range(2):  # the first frees what Python still held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)


class Scratch:
    """Tables written to the shared folder. They cut lineage and outlive any executor."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        atexit.register(self._leave)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write the rows once and return the written table."""
        self.n += 1
        at = self.path(f"{name}-{self.n}")
        df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        kept = self.spark.read.schema(df.schema).parquet(at)
        kept._scratch_at = at
        return kept

    def drop(self, df: DataFrame) -> None:
        remove(self.spark, df._scratch_at)

    def _leave(self) -> None:
        try:
            remove(self.spark, self.root)
        except Exception:  # the session may have ended before the interpreter does
            local = self.root.removeprefix("file://")
            if os.path.isdir(local):
                import shutil

                shutil.rmtree(local, ignore_errors=True)


def chunks_for(rows: int, per: int = CHUNK_ROWS) -> int:
    return max(1, min(MOST_CHUNKS, rows // per))


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    chunk: str,
    order: Sequence[str | Column],
    out: str,
    value: str | None = None,
) -> DataFrame:
    """Append the exclusive running total of ``value`` (rows, if none) per group, in the order (chunk, order).

    A hot group is dealt over its chunks: totals per chunk are added up first, and each chunk numbers its own rows.
    ``df`` must return the same rows each time it runs (a scan or a scratch table).
    """
    one = F.col(value) if value else F.lit(1).cast("long")
    keys = [*group, chunk]
    base = f"__{out}_base"
    totals = df.groupBy(*keys).agg(F.sum(one).alias("__total"))
    before = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn(base, F.coalesce(F.sum("__total").over(before), F.lit(0).cast("long")))
    right = bases.select(*(F.col(k).alias(f"__k_{k}") for k in keys), base)
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("__within", F.coalesce(F.sum(one).over(within), F.lit(0).cast("long")))
        .join(right, cond, "left")
        .withColumn(out, (F.col("__within") + F.col(base)).cast("long"))
        .drop("__within", base, *(f"__k_{k}" for k in keys))
    )


def components(scratch: Scratch, edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node reachable.

    Alternating large-star and small-star rounds, each a shuffle of edge rows with map-side minima. A star of any size
    is a few rows per task after partial aggregation, so a hot node is no task of its own. Each round is written to
    the shared folder. Nodes without an edge to another node have no row.
    """
    spark = scratch.spark
    cur = scratch.keep(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), name
    )
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("k", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("k")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.keep(large.filter("u <> v").distinct(), name)
        down = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(down, F.col("u") == F.col("k"))
        small = (
            small.filter("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(down.select(F.col("k").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        nxt = scratch.keep(small, name)
        scratch.drop(large)
        changed = nxt.join(cur, ["u", "v"], "left_anti").limit(1).count() or cur.join(nxt, ["u", "v"], "left_anti").limit(1).count()
        scratch.drop(cur)
        cur = nxt
        if not changed:
            return cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def by_bytes(texts: Sequence[bytes | None], most: int) -> Iterator[slice]:
    """Slices of consecutive texts of about ``most`` bytes; a longer text stands alone."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(texts):
        yield slice(start, len(texts))


def bit_table(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A table of 2**bits bits with those of the top bits of each 64-bit value set. At most 2**(bits-6) rows come back."""
    at = F.shiftrightunsigned(F.col(column), 64 - bits)
    words = (
        df.select(F.expr("1").alias("__one"), at.alias("__at"))
        .select(F.shiftrightunsigned("__at", 6).alias("w"), F.expr("shiftleft(1L, cast(__at & 63 as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint64)


def in_bits(table: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    at = values >> np.uint64(64 - bits)
    return (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def marked(docs: DataFrame, key: Column, table: np.ndarray, bits: int, wanted: bool) -> DataFrame:
    """The rows whose 64-bit key has its bit in the table, or with ``wanted`` false the others, those with a null key too."""
    shared, columns = docs.sparkSession.sparkContext.broadcast(table), docs.columns

    def keep(batches):
        import pyarrow as pa

        for b in batches:
            keys = b.column(b.num_columns - 1)
            hit = in_bits(shared.value, keys.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64), bits)
            hit &= keys.is_valid().to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(hit == wanted)).select(columns)

    return docs.withColumn("__mark", key).mapInArrow(keep, docs.schema)

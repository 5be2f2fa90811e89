"""Row identity and order: ordinals, positional zip, checked union, shuffled batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW_ID = "__ROW_ID__"
SLOT = 33  # bits that monotonically_increasing_id keeps for the place in a partition


def with_row_id(df: DataFrame, name: str = ROW_ID) -> DataFrame:
    """Append the 0-based position of each row in the frame's partition order.

    One pass counts the rows of each partition (a number per partition comes back), a second adds the offsets. The
    frame must return the same partitions each time, as scans and local data do.
    """
    marked = df.withColumn("__mono", F.monotonically_increasing_id())
    part = F.shiftright("__mono", SLOT)
    counts = marked.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    offsets, total = [], 0
    for r in sorted(counts, key=lambda r: r.p):
        offsets.append((r.p, total))
        total += r.n
    spark = df.sparkSession
    table = F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "__p long, __o long"))
    place = F.col("__mono").bitwiseAND(F.lit((1 << SLOT) - 1))
    return (
        marked.join(table, part == F.col("__p"), "left").withColumn(name, place + F.coalesce("__o", F.lit(0).cast("long"))).drop("__mono", "__p", "__o")
    )


def check_same_schema(frames: Sequence[DataFrame]) -> None:
    """Names, order, types and nullability must agree."""
    first = [(f.name, f.dataType, f.nullable) for f in frames[0].schema]
    for other in frames[1:]:
        own = [(f.name, f.dataType, f.nullable) for f in other.schema]
        if own != first:
            raise ValueError(f"schemas differ: {frames[0].schema.simpleString()} and {other.schema.simpleString()}")


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; a single frame comes back as it is. Unlike a plain union nothing is coerced or reordered."""
    if not frames:
        raise ValueError("no frame to unite")
    check_same_schema(frames)
    return reduce(DataFrame.union, frames)


def zip_columns(*frames: DataFrame, by: str | None = None) -> DataFrame:
    """Merge columns by row position; of columns with one name the last frame's stays, in the first one's place.

    ``by`` names an ordinal column that all frames hold; without it one is computed. Unequal lengths raise.
    """
    if len(frames) == 1:
        return frames[0]
    on = by or ROW_ID
    numbered = [f if by else with_row_id(f) for f in frames]
    sizes = [f.count() for f in numbered]
    if len(set(sizes)) > 1:
        raise ValueError(f"frames of unequal length: {sizes}")
    owner: dict[str, int] = {}
    for i, f in enumerate(numbered):
        owner.update({c: i for c in f.columns if c != on})
    slim = [f.select(on, *(c for c in f.columns if c != on and owner[c] == i)) for i, f in enumerate(numbered)]
    return reduce(lambda a, b: a.join(b, on), slim).select(*owner)


def concat(*frames: DataFrame, axis: int = 0) -> DataFrame:
    if axis == 0:
        return union_all(*frames)
    if axis == 1:
        return zip_columns(*frames)
    raise ValueError(f"axis must be 0 or 1, not {axis!r}")


def random_positions(df: DataFrame, seed: int, key: str = ROW_ID, chunks: int | None = None) -> DataFrame:
    """Append ``__POS__``, a seeded permutation of 0..n-1.

    Rows are ordered by a hash of their ordinal: hash ranges are numbered apart and their totals added up, so no task
    sorts all rows.
    """
    numbered = df if key in df.columns else with_row_id(df, key)
    hashed = numbered.withColumn("__h", F.xxhash64(F.lit(seed), F.col(key)))
    if chunks is None:
        chunks = max(1, min(65536, numbered.count() // 65536))
    hashed = hashed.withColumn("__c", F.pmod("__h", F.lit(chunks)))
    totals = hashed.groupBy("__c").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("__c").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0).cast("long")).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("__c").orderBy("__h", key)) - 1
    return hashed.withColumn("__i", inside).join(bases, F.col("__c") == F.col("__b")).withColumn("__POS__", (F.col("__base") + F.col("__i")).cast("long")).drop(
        "__h", "__c", "__b", "__base", "__i"
    )


def random_batches(df: DataFrame, size: int, seed: int = 0, rest: bool = False) -> DataFrame:
    """Rows with a ``batch_id``: one epoch without replacement in batches of exactly ``size``; the remainder is dropped,
    or with ``rest`` makes a last, shorter batch.

    The ordinal ``__ROW_ID__`` stays, so that a batch can be read in scan order.
    """
    if size < 1:
        raise ValueError("a batch holds at least one row")
    numbered = df if ROW_ID in df.columns else with_row_id(df)
    full = 0 if rest else numbered.count() // size
    if not full and not rest:
        raise ValueError(f"fewer rows than a batch of {size}")
    placed = random_positions(numbered, seed).withColumn("batch_id", F.floor(F.col("__POS__") / size).cast("long")).drop("__POS__")
    return placed if rest else placed.filter(F.col("batch_id") < full)


def map_batches(df: DataFrame, size: int, func: Callable | None = None, schema=None, seed: int = 0, rest: bool = False) -> DataFrame:
    """Apply ``func`` (Arrow table to Arrow table) to each random batch, in scan order, in parallel; each row once.
    ``rest`` as in random_batches()."""
    batches = random_batches(df, size, seed, rest)
    names = [c for c in df.columns if c != ROW_ID]
    if func is None:
        return batches.select("batch_id", *names)

    def one(table):
        return func(table.sort_by(ROW_ID).select(names))

    return batches.groupBy("batch_id").applyInArrow(one, schema or df.select(*names).schema)


def iter_batches(df: DataFrame, size: int, seed: int = 0) -> Iterator:
    """Random batches as Arrow tables, one at a time on the driver."""
    import pyarrow as pa

    batches = random_batches(df, size, seed)
    names = [c for c in df.columns if c != ROW_ID]
    # sorted by batch, so that consecutive rows make up a batch
    rows = batches.orderBy("batch_id", ROW_ID)
    held: list = []
    total = 0
    from ..streaming.transport import record_batches

    for b in record_batches(rows.select(*names)):
        held.append(b)
        total += b.num_rows
        while total >= size:
            whole = pa.Table.from_batches(held)
            yield whole.slice(0, size)
            rest = whole.slice(size)
            held, total = rest.to_batches(), rest.num_rows


def sample_rows(df: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """``count`` distinct rows, in scan order (by ordinal)."""
    numbered = df if ROW_ID in df.columns else with_row_id(df)
    picked = numbered.withColumn("__h", F.xxhash64(F.lit(seed), F.col(ROW_ID))).orderBy("__h", ROW_ID).limit(count)
    return picked.drop("__h").orderBy(ROW_ID)


def first_element(column: Column) -> Column:
    return F.element_at(column, 1)

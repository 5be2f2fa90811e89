"""Multi-codebook cell codes: training, encoding, probe ranking and one-step centroid updates.

There are n books of k full-length centroids each. A row's code is the mixed-radix number of its nearest centroid in
each book, book 0 the most significant digit. The cost of a code is the sum of the distances, so the best code of a
row needs n * k distances, never the k**n table.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import EPS, canonical, distance, list_matrix, literal, normalize, numpy_distance, pair_distance
from .rows import ROW_ID, sample_rows, with_row_id

#: Literals that an expression may hold (more of them would not compile); larger codebooks go to an Arrow kernel.
LITERALS = 256
#: Codes that may be ranked by enumeration.
ENUMERATED = 1 << 16
#: Rows that training may hold on the driver; larger tables are sampled down to it.
TRAIN_ROWS = 1 << 20


@dataclass(frozen=True)
class CoderConfig:
    metric: str = "l2"
    codebook_size: int = 8
    num_codebooks: int = 2
    batch_size: int = 2560
    num_epochs: int = 5
    seed: int = 0

    def __post_init__(self) -> None:
        canonical(self.metric)
        if min(self.codebook_size, self.num_codebooks, self.batch_size) < 1 or self.num_epochs < 0:
            raise ValueError(f"sizes must be positive: {self}")

    @property
    def cells(self) -> int:
        return self.codebook_size**self.num_codebooks


@dataclass(frozen=True)
class Coding:
    """Centroids (books, slots, dim) and the configuration that made them."""

    books: np.ndarray
    config: CoderConfig

    def __post_init__(self) -> None:
        if self.books.ndim != 3 or self.books.shape[:2] != (self.config.num_codebooks, self.config.codebook_size):
            raise ValueError(f"books of shape {self.books.shape} do not fit {self.config}")

    @property
    def dim(self) -> int:
        return self.books.shape[2]

    def meta(self) -> dict:
        return asdict(self.config) | {"dim": self.dim}

    def _weights(self) -> np.ndarray:
        n, k = self.books.shape[:2]
        return k ** np.arange(n - 1, -1, -1, dtype=np.int64)

    def encode_numpy(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        for book, weight in zip(self.books, self._weights(), strict=True):
            out += numpy_distance(self.config.metric, rows, book).argmin(1) * weight
        return out

    def costs(self, query: Sequence[float]) -> np.ndarray:
        """Distance of one vector to every centroid: (books, slots)."""
        q = np.asarray(query, np.float64)
        if q.shape != (self.dim,):
            raise ValueError(f"a vector of length {self.dim} is needed, not of shape {q.shape}")
        return np.stack([numpy_distance(self.config.metric, book, q[None, :])[:, 0] for book in self.books])

    def ranked(self, query: Sequence[float], count: int | None = None) -> list[int]:
        """Codes by rising cost, ties by code; all of them without ``count``, never more than there are."""
        costs = self.costs(query)
        n, k = costs.shape
        count = self.config.cells if count is None else min(int(count), self.config.cells)
        if self.config.cells <= ENUMERATED:
            total = np.zeros(1)
            for book in costs:
                total = (total[:, None] + book[None, :]).ravel()
            return np.lexsort((np.arange(len(total)), total))[:count].tolist()
        # multi-sequence traversal: books sorted by cost, cells opened from the cheapest corner on
        order = np.argsort(costs, axis=1, kind="stable")
        weights = self._weights()

        def entry(at):
            slots = [int(order[j, i]) for j, i in enumerate(at)]
            return float(sum(costs[j, s] for j, s in enumerate(slots))), int(sum(w * s for w, s in zip(weights, slots, strict=True))), at

        start = (0,) * n
        heap, seen, out = [entry(start)], {start}, []
        while heap and len(out) < count:
            _, code, at = heapq.heappop(heap)
            out.append(code)
            for j in range(n):
                nxt = (*at[:j], at[j] + 1, *at[j + 1 :])
                if nxt[j] < k and nxt not in seen:
                    seen.add(nxt)
                    heapq.heappush(heap, entry(nxt))
        return out

    def digits(self, v: Column) -> list[Column]:
        """Slot of the nearest centroid in each book (the first of equals); null for an unusable vector."""
        out = []
        for book in self.books:
            d = F.array(*(distance(self.config.metric, v, c) for c in book))
            out.append((F.array_position(d, F.array_min(d)) - 1).cast("long"))
        return out

    def code(self, v: Column) -> Column:
        """Code of each row as a column: an expression for small codebooks, else a vectorised kernel."""
        if self.books.size <= LITERALS:
            total = F.lit(0).cast("long")
            for digit, weight in zip(self.digits(v), self._weights().tolist(), strict=True):
                total = total + digit * F.lit(weight).cast("long")
            return total
        return self._kernel(v, None)

    def codes(self, v: Column, count: int | None = 1) -> Column:
        """Ranked codes of each row, cheapest first, as array<bigint>."""
        return self._kernel(v, self.config.cells if count is None else count)

    def _kernel(self, v: Column, count: int | None) -> Column:
        own = self

        if count is None:

            @F.arrow_udf("bigint")
            def top(column: pa.Array) -> pa.Array:
                rows, good = list_matrix(column, own.dim)
                return pa.array(own.encode_numpy(rows), mask=~(good & ~np.isnan(rows).any(1)))

            return top(v)

        @F.arrow_udf("array<bigint>")
        def many(column: pa.Array) -> pa.Array:
            rows, good = list_matrix(column, own.dim)
            good &= ~np.isnan(rows).any(1)
            return pa.array([own.ranked(r, count) if g else None for r, g in zip(rows, good, strict=True)], pa.list_(pa.int64()))

        return many(v)


def call(target, coding: Coding, count: int | None = None):
    """Ranked codes of vectors; the answer is of the kind of the target (array, Arrow array, or frame and column)."""
    if isinstance(target, tuple):
        df, column = target
        return df.withColumn("codes", coding.codes(F.col(column), count))
    if isinstance(target, (pa.Array, pa.ChunkedArray)):
        return pa.array([None if x is None else coding.ranked(x, count) for x in target.to_pylist()], pa.list_(pa.int64()))
    rows = np.asarray(target)
    if rows.ndim == 1:
        return np.array(coding.ranked(rows, count))
    return np.array([coding.ranked(r, count) for r in rows])


def update(metric: str, centroids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """One step: a centroid becomes the mean of itself and its members; without members it stays."""
    unit = lambda x: x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), EPS)
    if canonical(metric) == "cosine":
        centroids, rows = unit(centroids), unit(rows)
    nearest = numpy_distance(metric, rows, centroids).argmin(1)
    total, count = centroids.copy(), np.ones(len(centroids))
    np.add.at(total, nearest, rows)
    np.add.at(count, nearest, 1)
    out = total / count[:, None]
    return unit(out) if canonical(metric) == "cosine" else out


def train(df: DataFrame, column: str, config: CoderConfig, most_rows: int = TRAIN_ROWS) -> Coding:
    """Books from seeded sample rows, improved by minibatches; every book sees its own slice of each batch.

    Epochs permute the rows and drop the remainder. The rows are gathered on the driver: all of them up to
    ``most_rows``, else a uniform sample of that many, so the memory has a bound whatever the table.
    """
    n, k, size = config.num_codebooks, config.codebook_size, config.batch_size
    numbered = df.select(F.col(column).alias("v"), *([ROW_ID] if ROW_ID in df.columns else [])).filter("v is not null")
    numbered = numbered if ROW_ID in numbered.columns else with_row_id(numbered)
    total = numbered.count()
    if total < n * k:
        raise ValueError(f"{total} vectors cannot fill {n} books of {k}")
    if config.num_epochs and min(total, most_rows) < n * size:
        raise ValueError(f"{min(total, most_rows)} vectors are fewer than a batch of {n} x {size}")
    rows = sample_rows(numbered, most_rows, config.seed) if total > most_rows else numbered.orderBy(ROW_ID)
    got = rows.select("v").toArrow().column("v")
    dim = len(got[0])
    data, good = list_matrix(got, dim)
    if not good.all():
        raise ValueError(f"vectors of length {dim} without nulls are needed")
    rng = np.random.default_rng(config.seed)
    books = data[np.sort(rng.choice(len(data), n * k, replace=False))].reshape(n, k, dim).copy()
    for _ in range(config.num_epochs):
        order = rng.permutation(len(data))
        order = order[: len(order) - len(order) % (n * size)]
        for batch in np.split(order, len(order) // (n * size)):
            slices = data[np.sort(batch)].reshape(n, size, dim)
            books = np.stack([update(config.metric, b, s) for b, s in zip(books, slices, strict=True)])
    return Coding(books, config)


def books_frame(spark, coding: Coding) -> DataFrame:
    rows = [(j, s, [float(x) for x in c]) for j, book in enumerate(coding.books) for s, c in enumerate(book)]
    return spark.createDataFrame(rows, "book int, slot int, centroid array<double>")


def centroid_update(df: DataFrame, column: str, coding: Coding) -> DataFrame:
    """One full-table update as aggregations: rows (book, slot, members, centroid)."""
    spark = df.sparkSession
    cosine = canonical(coding.config.metric) == "cosine"
    n, k = coding.books.shape[:2]

    def add(batches):
        total, count = np.zeros(coding.books.shape), np.zeros((n, k), np.int64)
        for b in batches:
            rows, good = list_matrix(b.column(0), coding.dim)
            rows = rows[good & ~np.isnan(rows).any(1)]
            for j, book in enumerate(coding.books):
                nearest = numpy_distance(coding.config.metric, rows, book).argmin(1)
                own = rows / np.maximum(np.sqrt((rows * rows).sum(1, keepdims=True)), EPS) if cosine else rows
                np.add.at(total[j], nearest, own)
                np.add.at(count[j], nearest, 1)
        some = np.argwhere(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some[:, 0], pa.int32()), pa.array(some[:, 1], pa.int32()), pa.array(count[count > 0], pa.int64()), pa.array(list(total[count > 0]), pa.list_(pa.float64()))],
            ["book", "slot", "m", "xs"],
        )

    # each task adds up its rows: books x slots rows of it are left
    parts = df.select(column).mapInArrow(add, "book int, slot int, m long, xs array<double>")
    flat = parts.select("book", "slot", "m", F.posexplode("xs").alias("at", "x"))
    sums = flat.groupBy("book", "slot", "at").agg(F.sum("x").alias("s"), F.sum("m").alias("m"))
    old = books_frame(spark, coding)
    old = old.select("book", "slot", F.posexplode(normalize(F.col("centroid")) if cosine else F.col("centroid")).alias("at", "c"))
    new = old.join(sums, ["book", "slot", "at"], "left").withColumn("m", F.coalesce("m", F.lit(0).cast("long")))
    new = new.withColumn("x", (F.col("c") + F.coalesce("s", F.lit(0.0))) / (1 + F.col("m")))
    out = new.groupBy("book", "slot").agg(F.max("m").alias("members"), F.array_sort(F.collect_list(F.struct("at", "x"))).alias("xs"))
    centroid = F.col("xs.x")
    return out.select("book", "slot", "members", (normalize(centroid) if cosine else centroid).alias("centroid"))


def assign(df: DataFrame, column: str, centroids: Sequence[Sequence[float]], metric: str) -> DataFrame:
    """Append ``slot``, the nearest centroid."""
    d = F.array(*(pair_distance(metric, F.col(column), literal(c)) for c in centroids))
    return df.withColumn("slot", (F.array_position(d, F.array_min(d)) - 1).cast("int"))

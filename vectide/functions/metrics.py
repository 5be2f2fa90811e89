"""Distances and vector kernels as columns. Smaller is nearer in every metric."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The five metric names and what they stand for.
METRICS = {"l2": "l2", "euclidean": "l2", "cosine": "cosine", "dot": "dot", "inner_product": "dot"}
#: Least norm in cosine and normalisation.
EPS = 1e-12
#: Vectors up to this length are unrolled into generated code; longer ones use array functions.
UNROLLED = 128
#: Estimated input bytes from which the Arrow kernel pays for its Python workers.
ARROW_BYTES = 256 << 20


def canonical(metric: str) -> str:
    try:
        return METRICS[metric]
    except (KeyError, TypeError):
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}") from None


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _unrolled(v: Column, q: Sequence[float], term) -> Column:
    total = F.lit(0.0)
    for i, x in enumerate(q):
        total = total + term(F.get(v, F.lit(i)).cast("double"), float(x))
    return F.when(F.size(v) == len(q), total)


def norm(v: Column) -> Column:
    return F.sqrt(_dot(v, v))


def normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm(v), F.lit(EPS)))


def pair_distance(metric: str, u: Column, v: Column) -> Column:
    """Distance of two vector columns; null if either is null or the lengths differ."""
    kind = canonical(metric)
    if kind == "l2":
        out = F.sqrt(F.aggregate(F.zip_with(u, v, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))
    elif kind == "dot":
        out = -_dot(u, v)
    else:
        out = 0.5 - 0.5 * _dot(u, v) / (F.greatest(norm(u), F.lit(EPS)) * F.greatest(norm(v), F.lit(EPS)))
    return F.when(F.size(u) == F.size(v), out)


def distance(metric: str, v: Column, query: Sequence[float]) -> Column:
    """Distance of a vector column to one query vector, in double precision.

    l2: root of the summed squares. dot: minus the product. cosine: one half minus half the cosine, so a zero vector
    is at 0.5. A null vector, a null element or another length gives null; NaN stays NaN.
    """
    kind = canonical(metric)
    q = [float(x) for x in query]
    if len(q) > UNROLLED:
        return pair_distance(metric, v, literal(q))
    if kind == "l2":
        return F.sqrt(_unrolled(v, q, lambda x, y: (x - F.lit(y)) * (x - F.lit(y))))
    product = _unrolled(v, q, lambda x, y: x * F.lit(y))
    if kind == "dot":
        return -product
    length = F.sqrt(_unrolled(v, q, lambda x, _: x * x))
    own = max(float(np.sqrt(np.dot(q, q))), EPS)
    return 0.5 - 0.5 * product / (F.greatest(length, F.lit(EPS)) * F.lit(own))


def numpy_distance(metric: str, v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of rows (m, d) to queries (p, d): (m, p), in double precision."""
    kind = canonical(metric)
    v, q = np.atleast_2d(v).astype(np.float64), np.atleast_2d(q).astype(np.float64)
    if kind == "l2":
        return np.sqrt(np.stack([((v - x) ** 2).sum(1) for x in q], 1))
    if kind == "dot":
        return -(v @ q.T)
    a = np.maximum(np.sqrt((v * v).sum(1)), EPS)[:, None]
    b = np.maximum(np.sqrt((q * q).sum(1)), EPS)[None, :]
    return 0.5 - 0.5 * (v @ q.T) / (a * b)


def list_matrix(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow list column as (rows, dim) doubles and which rows are usable; others are zero."""
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    good = sizes == dim
    out = np.zeros((len(column), dim))
    if good.any():
        values = column.filter(pa.array(good)).flatten()
        missing = values.is_null().to_numpy(zero_copy_only=False).reshape(-1, dim).any(1)
        out[good] = values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
        good[np.flatnonzero(good)[missing]] = False
        out[~good] = 0
    return out, good


def arrow_distance(metric: str, v: Column, query: Sequence[float]) -> Column:
    """The same distance by a vectorised kernel over Arrow batches, for large scans."""
    kind, q = canonical(metric), np.asarray(query, np.float64)

    @F.arrow_udf("double")
    def kernel(column: pa.Array) -> pa.Array:
        rows, good = list_matrix(column, len(q))
        return pa.array(numpy_distance(kind, rows, q[None, :])[:, 0], mask=~good)

    return kernel(v)


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def best_distance(df: DataFrame, metric: str, column: str, query: Sequence[float]) -> Column:
    """Generated code for short vectors and small inputs, the Arrow kernel for long vectors over large inputs."""
    if len(query) > UNROLLED and estimated_bytes(df) >= ARROW_BYTES:
        return arrow_distance(metric, F.col(column), query)
    return distance(metric, F.col(column), query)

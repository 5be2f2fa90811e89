"""Search and read plans: filter, distance, projection, top k - in this order, as one lazy frame."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import best_distance, canonical, list_matrix, numpy_distance
from ..operators.coder import Coding
from ..operators.rows import ROW_ID

CODE, DISTANCE, CELL = "__CODED_ID__", "__DISTANCE__", "__CELL__"
#: Partition directories of an index at most.
CELLS = 1024


def condition(filter: Column | str | None) -> Column | None:
    return F.expr(filter) if isinstance(filter, str) else filter


def read(df: DataFrame, select: Sequence[str] | None = None, filter: Column | str | None = None) -> DataFrame:
    """Filter, then project in the order of the list. SQL rules hold for NaN and for null in negated IN."""
    if filter is not None:
        df = df.filter(condition(filter))
    return df if select is None else df.select(*(df[c] for c in select))


def query_vector(target, dim: int | None = None) -> list[float]:
    """One vector from a list, array, Arrow scalar, or an Arrow array or chunked array of one vector."""
    if hasattr(target, "to_pylist"):
        target = target.to_pylist()
    elif hasattr(target, "as_py"):
        target = target.as_py()
    out = np.asarray(target, np.float64)
    if out.ndim == 2 and len(out) == 1:
        out = out[0]
    if out.ndim != 1:
        raise ValueError(f"one query vector is needed, not an array of shape {out.shape}")
    if dim is not None and len(out) != dim:
        raise ValueError(f"the query has length {len(out)}, the column {dim}")
    return out.tolist()


def element_type(df: DataFrame, column: str) -> str:
    kind = df.schema[column].dataType
    if not hasattr(kind, "elementType"):
        raise ValueError(f"{column} is no vector column")
    name = kind.elementType.simpleString()
    return name if name in ("float", "double") else "double"


def probe_mask(coding: Coding, query: Sequence[float], probes: int, cells: bool) -> Column:
    """Rows in the cells nearest to the query; with ``cells`` the partition column prunes directories too."""
    codes = coding.ranked(query, probes)
    mask = F.col(CODE).isin(codes)
    return mask & F.col(CELL).isin(sorted({c % CELLS for c in codes})) if cells else mask


def search(
    df: DataFrame,
    column: str,
    target,
    metric: str | None = None,
    select: Sequence[str] | None = None,
    filter: Column | str | None = None,
    maxval: int | None = None,
    coding: Coding | None = None,
    probes: int | None = None,
    tie: str | None = None,
    exact_type: bool = True,
    dim: int | None = None,
) -> DataFrame:
    """Rows with their distance, the nearest ``maxval`` or all of them.

    The filter and the probed cells come first, so k counts matching rows only. With ``maxval`` the rows are ordered
    by distance (ties by ``tie``, else by the row's ordinal if there is one) and rows of null or NaN distance are left
    out; without it all rows stay, unordered. A search in probed cells may return fewer than ``maxval`` rows.
    """
    query = query_vector(target, dim if dim is not None else coding.dim if coding else None)
    metric = metric or (coding.config.metric if coding and probes is not None else None)
    if metric is None:
        raise ValueError("a metric is needed")
    canonical(metric)
    shown = [c for c in (select if select is not None else df.columns) if c not in (DISTANCE, CELL) and (select is not None or c != ROW_ID)]
    if filter is not None:
        df = df.filter(condition(filter))
    if coding is not None and probes is not None:
        df = df.filter(probe_mask(coding, query, probes, CELL in df.columns))
    d = best_distance(df, metric, column, query)
    df = df.withColumn("__d", d)
    out = d = F.col("__d")
    if exact_type:
        out = d.cast(element_type(df, column))
    last = out.alias(DISTANCE)
    if maxval is None:
        return df.select(*shown, last)
    if maxval < 0:
        raise ValueError("maxval cannot be negative")
    order = [F.col("__d"), *([F.col(tie)] if tie else [F.col(ROW_ID)] if ROW_ID in df.columns else [])]
    near = df.filter(F.col("__d").isNotNull() & ~F.isnan("__d")).orderBy(*order).limit(maxval)
    return near.select(*shown, last)


def search_many(df: DataFrame, column: str, queries: DataFrame, metric: str, maxval: int, id_col: str, query_id: str = "query_id", target: str = "target", most: int = 65536) -> DataFrame:
    """The ``maxval`` nearest rows of each vector of a bounded query set (an extension): query id, rank, id, distance.

    The queries, ``most`` at most, are held by every task; larger sets raise and go in blocks. A task keeps the nearest
    rows of each query while it scans, so at most maxval rows of a query leave it.
    """
    kind = canonical(metric)
    held = queries.select(query_id, target).limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"more than {most} queries; ask in blocks")
    vectors = np.array([query_vector(r[1]) for r in held]) if held else np.zeros((0, 1))
    ids = [r[0] for r in held]
    shared = df.sparkSession.sparkContext.broadcast(vectors)
    row_kind, query_kind = dict(df.dtypes)[id_col], dict(queries.dtypes)[query_id]

    def nearest(batches):
        import pyarrow as pa

        q = shared.value
        best = [(np.zeros(0), pa.array([], None)) for _ in q]
        found_type = None
        for b in batches:
            found_type = b.column(0).type
            rows, good = list_matrix(b.column(1), q.shape[1])
            at = np.flatnonzero(good)
            if not len(at):
                continue
            d = numpy_distance(kind, rows[at], q)
            own = b.column(0).take(pa.array(at))
            for j in range(len(q)):
                near = np.flatnonzero(~np.isnan(d[:, j]))
                if len(best[j][0]) == maxval:
                    near = near[d[near, j] <= best[j][0][-1]]
                if not len(near):
                    continue
                all_d = np.concatenate((best[j][0], d[near, j]))
                all_i = pa.concat_arrays([best[j][1].cast(found_type), own.take(pa.array(near))])
                order = np.lexsort((np.argsort(np.argsort(all_i.to_numpy(zero_copy_only=False), kind="stable")), all_d))[:maxval]
                best[j] = (all_d[order], all_i.take(pa.array(order)))
        for j, (d, i) in enumerate(best):
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), j, np.int32)), i.cast(found_type), pa.array(d)], ["__j", "__i", "__d"])

    local = df.select(id_col, column).mapInArrow(nearest, f"__j int, __i {row_kind}, __d double")
    rank = F.row_number().over(Window.partitionBy("__j").orderBy("__d", "__i"))
    named = df.sparkSession.createDataFrame(list(enumerate(ids)), f"__n int, {query_id} {query_kind}") if ids else df.sparkSession.createDataFrame([], f"__n int, {query_id} {query_kind}")
    top = local.withColumn("rank", rank).filter(F.col("rank") <= maxval)
    return top.join(F.broadcast(named), F.col("__j") == F.col("__n")).select(query_id, "rank", F.col("__i").alias(id_col), F.col("__d").alias(DISTANCE))

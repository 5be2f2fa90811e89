"""Nested tensors: dicts of tensors with one row count as struct columns; each leaf field's metadata holds its shape."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .rows import ROW_ID
from .tensors import _NUMPY, TensorType, _numpy, element_type


def _rows(values) -> int:
    sizes = {_rows(v) if isinstance(v, Mapping) else len(_numpy(v)) for v in values.values()}
    if len(sizes) != 1:
        raise ValueError(f"the tensors have different row counts: {sorted(sizes)}")
    return sizes.pop()


def nested_type(values: Mapping) -> StructType:
    """The struct type of a dict of tensors (rows, *shape)."""
    fields = []
    for name, v in values.items():
        if isinstance(v, Mapping):
            fields.append(StructField(name, nested_type(v)))
        else:
            a = _numpy(v)
            fields.append(TensorType(a.shape[1:], element_type(a.dtype)).field(name))
    return StructType(fields)


def shapes(kind: StructType) -> dict:
    """Shapes by name, nested like the type."""
    return {f.name: shapes(f.dataType) if isinstance(f.dataType, StructType) else TensorType.of(f).shape for f in kind}


def _arrow(values: Mapping):
    import pyarrow as pa

    arrays = []
    for v in values.values():
        if isinstance(v, Mapping):
            arrays.append(_arrow(v))
        else:
            a = _numpy(v)
            flat = a.astype(_NUMPY[element_type(a.dtype)]).reshape(len(a), -1)
            arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel())))
    return pa.StructArray.from_arrays(arrays, list(values))


def from_numpy(spark: SparkSession, name: str, values: Mapping, **others) -> DataFrame:
    """A frame with a nested tensor column, and ``others`` as plain columns."""
    import pyarrow as pa

    _rows(values)
    kind = nested_type(values)
    df = spark.createDataFrame(pa.table({**{k: pa.array(v) for k, v in others.items()}, name: _arrow(values)}))
    schema = StructType([StructField(f.name, kind, f.nullable) if f.name == name else f for f in df.schema])
    return df.to(schema)


def _unpack(column, kind: StructType) -> dict:
    out = {}
    for i, f in enumerate(kind):
        own = column.field(i)
        if isinstance(f.dataType, StructType):
            out[f.name] = _unpack(own, f.dataType)
        else:
            t = TensorType.of(f)
            out[f.name] = own.flatten().to_numpy(zero_copy_only=False).astype(_NUMPY[t.element]).reshape(len(column), *t.shape)
    return out


def to_numpy(df: DataFrame, name: str) -> dict:
    """The dict of tensors of a nested column."""
    if ROW_ID in df.columns:
        df = df.orderBy(ROW_ID)
    column = df.select(name).toArrow().column(name).combine_chunks()
    if column.null_count:
        raise ValueError(f"{name} holds null rows")
    return _unpack(column, df.schema[name].dataType)


def scalar_to_numpy(value, kind: StructType) -> dict:
    """The dict of tensors of one row value."""
    return {
        f.name: scalar_to_numpy(value[f.name], f.dataType)
        if isinstance(f.dataType, StructType)
        else np.asarray(value[f.name], _NUMPY[TensorType.of(f).element]).reshape(TensorType.of(f).shape)
        for f in kind
    }


def find(kind: StructType, *keys: str) -> StructField:
    """The field at a path of names."""
    at = None
    for key in keys:
        if not isinstance(kind, StructType) or key not in kind.names:
            raise ValueError(f"no field {'.'.join(keys)}")
        at = kind[key]
        kind = at.dataType
    if at is None:
        raise ValueError("a path needs a name")
    return at


def to_field(df: DataFrame, name: str, *keys: str, alias: str | None = None) -> DataFrame:
    """The sub-tensor or the nested sub-tensors at a path, as one column that keeps its shapes. Only that leaf is read."""
    column = df.schema[name].dataType
    if not isinstance(column, StructType):
        raise ValueError(f"{name} is no nested column")
    field = find(column, *keys)
    path = ".".join(f"`{k}`" for k in (name, *keys))
    out = alias or keys[-1]
    picked = df.select(F.col(path).alias(out))
    return picked if isinstance(field.dataType, StructType) else picked.withMetadata(out, field.metadata)

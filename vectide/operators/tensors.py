"""Tensor columns: a flat array column whose field metadata holds the shape, and the quantized kind.

Spark has no extension types and no fixed-size lists, so shape, scale and shift live in field metadata, which survives
a Parquet round trip. Row values are flat arrays in row-major order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import prod

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructField

from .rows import ROW_ID

_SPARK = {"float32": FloatType(), "float64": DoubleType(), "int64": LongType(), "int32": IntegerType(), "int16": ShortType(), "int8": ByteType(), "uint8": ShortType(), "float16": FloatType()}
_NUMPY = {FloatType(): "float32", DoubleType(): "float64", LongType(): "int64", IntegerType(): "int32", ShortType(): "int16", ByteType(): "int8"}
SHAPE, KIND, SCALE, SHIFT = "shape", "kind", "scale", "shift"


def _numpy(values) -> np.ndarray:
    """NumPy values of an array or of a tensor that offers them."""
    return np.asarray(values.detach().cpu().numpy() if hasattr(values, "detach") else values)


@dataclass(frozen=True)
class TensorType:
    """Shape of one row's tensor and its element type."""

    shape: tuple[int, ...]
    element: DataType

    @property
    def size(self) -> int:
        return prod(self.shape)

    def field(self, name: str, nullable: bool = True) -> StructField:
        return StructField(name, ArrayType(self.element), nullable, {KIND: "tensor", SHAPE: list(self.shape)})

    @classmethod
    def of(cls, field: StructField) -> "TensorType":
        if SHAPE not in (field.metadata or {}):
            raise ValueError(f"{field.name} is no tensor column")
        return cls(tuple(field.metadata[SHAPE]), field.dataType.elementType)


def element_type(dtype) -> DataType:
    try:
        return _SPARK[np.dtype(dtype).name]
    except KeyError:
        raise ValueError(f"no Spark type for {dtype}") from None


def from_numpy(spark: SparkSession, name: str, values, **others) -> DataFrame:
    """A frame with a tensor column of values (rows, *shape), and ``others`` as plain columns, in row order."""
    import pyarrow as pa

    rows = _numpy(values)
    if rows.ndim < 1:
        raise ValueError("the first axis counts rows")
    kind = TensorType(rows.shape[1:], element_type(rows.dtype))
    wide = rows.astype(_NUMPY[kind.element]).reshape(len(rows), -1)
    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * wide.shape[1]), pa.array(wide.ravel()))
    columns = {k: pa.array(_numpy(v)) if not isinstance(v, (list, tuple)) else pa.array(v) for k, v in others.items()}
    df = spark.createDataFrame(pa.table({**columns, name: flat}))
    return df.withMetadata(name, kind.field(name).metadata)


def to_numpy(df: DataFrame, name: str) -> np.ndarray:
    """The tensors of a column: (rows, *shape). By ordinal, if the frame holds one. Null rows raise."""
    kind = TensorType.of(df.schema[name])
    if ROW_ID in df.columns:
        df = df.orderBy(ROW_ID)
    column = df.select(name).toArrow().column(name).combine_chunks()
    if column.null_count:
        raise ValueError(f"{name} holds null tensors")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(_NUMPY[kind.element]).reshape(-1, *kind.shape)


def scalar(values) -> Column:
    """One tensor as a literal array column."""
    flat = _numpy(values)
    return F.array(*(F.lit(x) for x in flat.ravel().tolist())).cast(ArrayType(element_type(flat.dtype)))


def scalar_to_numpy(value: Sequence, field: StructField) -> np.ndarray:
    """The tensor of a row value."""
    kind = TensorType.of(field)
    return np.asarray(value, _NUMPY[kind.element]).reshape(kind.shape)


def valid(df: DataFrame, name: str) -> Column:
    """Whether a value has as many elements as the shape."""
    return F.size(name) == TensorType.of(df.schema[name]).size


# quantized tensors

#: Levels of the reduced range: 8-bit values whose step is a 127th of the range.
LEVELS = 127


def parameters(df: DataFrame, name: str) -> tuple[float, int]:
    """Scale and shift of a whole column from its least and greatest element, zero included. One aggregation."""
    low, high = df.agg(F.min(F.array_min(name)).cast("double"), F.max(F.array_max(name)).cast("double")).first()
    low, high = min(low or 0.0, 0.0), max(high or 0.0, 0.0)
    scale = (high - low) / LEVELS or 1.0
    return scale, int(np.clip(round(-low / scale), 0, 255))


def quantized(field: StructField) -> bool:
    return (field.metadata or {}).get(KIND) == "quint8"


def quantize(df: DataFrame, name: str, scale: float | None = None, shift: int | None = None) -> DataFrame:
    """Replace a tensor column by unsigned 8-bit levels (array<short>); a quantized column stays as it is.

    level = clamp(rint(x / scale) + shift, 0, 255), rounding halves to even; scale and shift are those of the whole
    column unless given, and are kept in the field metadata beside the shape.
    """
    field = df.schema[name]
    if quantized(field):
        return df
    if (scale is None) != (shift is None):
        raise ValueError("scale and shift come together")
    if scale is None:
        scale, shift = parameters(df, name)
    level = F.transform(name, lambda x: F.greatest(F.lit(0), F.least(F.lit(255), (F.rint(x.cast("double") / F.lit(scale)) + F.lit(shift)).cast("int"))).cast("short"))
    meta = {k: v for k, v in (field.metadata or {}).items() if k != KIND} | {KIND: "quint8", SCALE: float(scale), SHIFT: int(shift)}
    return df.withColumn(name, level).withMetadata(name, meta)


def dequantize(df: DataFrame, name: str) -> DataFrame:
    """scale * (level - shift) as floats; the column is a tensor again."""
    field = df.schema[name]
    if not quantized(field):
        raise ValueError(f"{name} is not quantized")
    scale, shift = field.metadata[SCALE], field.metadata[SHIFT]
    meta = {k: v for k, v in field.metadata.items() if k not in (KIND, SCALE, SHIFT)} | {KIND: "tensor"}
    return df.withColumn(name, F.transform(name, lambda q: (F.lit(scale) * (q - F.lit(shift)).cast("double")).cast("float"))).withMetadata(name, meta)


class QuantizedArray(np.ndarray):
    """Levels with their scale and shift; slices and copies keep both."""

    def __new__(cls, levels, scale: float, shift: int) -> "QuantizedArray":
        out = np.asarray(levels, np.uint8).view(cls)
        out.scale, out.shift = float(scale), int(shift)
        return out

    def __array_finalize__(self, other) -> None:
        self.scale, self.shift = getattr(other, "scale", 1.0), getattr(other, "shift", 0)

    def dequantize(self) -> np.ndarray:
        return (self.scale * (np.asarray(self).astype(np.float64) - self.shift)).astype(np.float32)


def quantize_numpy(values) -> QuantizedArray:
    if isinstance(values, QuantizedArray):
        return values
    x = _numpy(values).astype(np.float64)
    low, high = min(float(x.min(initial=0.0)), 0.0), max(float(x.max(initial=0.0)), 0.0)
    scale = (high - low) / LEVELS or 1.0
    shift = int(np.clip(round(-low / scale), 0, 255))
    return QuantizedArray(np.clip(np.rint(x / scale) + shift, 0, 255), scale, shift)


def quantized_to_numpy(df: DataFrame, name: str) -> QuantizedArray:
    field = df.schema[name]
    if not quantized(field):
        raise ValueError(f"{name} is not quantized")
    return QuantizedArray(to_numpy(df, name), field.metadata[SCALE], field.metadata[SHIFT])


def quantized_from_numpy(spark: SparkSession, name: str, values: QuantizedArray, **others) -> DataFrame:
    df = from_numpy(spark, name, np.asarray(values), **others)
    meta = df.schema[name].metadata | {KIND: "quint8", SCALE: values.scale, SHIFT: values.shift}
    return df.withMetadata(name, meta)


def quantized_scalar(value: Sequence, field: StructField) -> QuantizedArray:
    """The levels of a row value, with the scale and shift of its column."""
    return QuantizedArray(scalar_to_numpy(value, field), field.metadata[SCALE], field.metadata[SHIFT])

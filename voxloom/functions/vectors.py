"""Column functions on vectors held as arrays; sums run in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column) -> Column:
    """v with unit length; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine, or -1 when the lengths differ or a vector is zero."""
    both = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (both > 0), dot(a, b) / both).otherwise(F.lit(-1.0))


def is_valid(v: Column) -> Column:
    """Not empty, all values finite, not all zero (Spark orders NaN above infinity, so one test rejects both)."""
    finite = F.forall(v, lambda x: F.abs(x) < F.lit(float("inf")))
    return (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


@F.arrow_udf(BinaryType())
def pack(v: pa.Array) -> pa.Array:
    """A vector as little-endian 32-bit floats; null stays null."""
    return pa.array([None if x is None else np.asarray(x, dtype="<f4").tobytes() for x in v.to_pylist()], pa.binary())


@F.arrow_udf(ArrayType(FloatType()))
def unpack(raw: pa.Array) -> pa.Array:
    """The vector that pack made; null stays null."""
    return pa.array([None if x is None else np.frombuffer(x, dtype="<f4") for x in raw.to_pylist()], pa.list_(pa.float32()))

"""Vectors of integers: what the searches and clusters of vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components are multiplied by SCALE and rounded down.
SCALE = 64
LONG_MAX, LONG_MIN = 2**63 - 1, -(2**63)
#: float64 holds integers exactly below this.
EXACT = 2.0**53


def usable(vector: str, size: int | None = None) -> Column:
    """The vector and all its components are there and finite; it has ``size`` components if that is given."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    fine = F.col(vector).isNotNull() & ~F.coalesce(odd, F.lit(False))
    return fine if size is None else fine & (F.size(vector) == size)


def integers(vector: str) -> Column:
    """floor(SCALE * x) of each component; beyond the range of long it is the range's end."""
    return F.transform(vector, lambda x: F.floor(F.lit(SCALE) * x.cast("double")))


def integer_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int | None = None) -> DataFrame:
    """key as long and ``v``, the integers of the vector; vectors that can't be used are left out."""
    return table.filter(usable(vector, size)).select(F.col(key).cast("long").alias("key"), integers(vector).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow column of lists of ``width`` integers, one row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64, copy=False).reshape(len(column), width)


def largest(m: np.ndarray) -> int:
    """The largest absolute value."""
    return max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0


def as_long(values: np.ndarray) -> np.ndarray:
    """Integers of any size as 64-bit ones; beyond the range of long they are the range's ends."""
    if values.dtype != object:
        return values.astype(np.int64)
    return np.array([min(max(int(x), LONG_MIN), LONG_MAX) for x in values], dtype=np.int64)

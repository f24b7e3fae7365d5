"""Embedding columns as numpy matrices: which rows hold a usable vector, exact integer products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Neither null nor holding a null or non-finite entry."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))


def common_length(df: DataFrame, vector: str) -> tuple[int, int]:
    """The most frequent length of ``vector`` (the larger of equally frequent ones) and its number of rows."""
    lengths = df.groupBy(F.size(vector).alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return (0, 0) if lengths is None else (lengths["length"], lengths["count"])


def scaled(vector: str, factor: int, limit: int) -> Column:
    """``floor(factor * x)`` of every entry as long, held within ``limit`` on either side."""
    return F.transform(
        vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * factor, F.lit(float(limit))), F.lit(float(-limit))))
    )


def matrix(column: pa.Array, length: int, dtype: type = np.int64) -> np.ndarray:
    """A list column without nulls, all of one length, as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), length)


def exact_product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``left @ right`` of integer matrices without rounding: in floats as far as they are exact, else in Python integers."""
    inner = left.shape[1]
    top = int(np.abs(left).max(initial=0)) * int(np.abs(right).max(initial=0))
    if top * inner < 1 << 24:
        return (left.astype(np.float32) @ right.astype(np.float32)).astype(np.int64)
    if top * inner < 1 << 53:
        return (left.astype(np.float64) @ right.astype(np.float64)).astype(np.int64)
    if inner > 64:
        half = inner // 2
        return exact_product(left[:, :half], right[:half]).astype(object) + exact_product(left[:, half:], right[half:])
    return left.astype(object) @ right.astype(object)

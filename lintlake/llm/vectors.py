"""Vectors as whole numbers: what the operators over embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Products and sums below it are exact in doubles.
EXACT = 2**53


def usable(vector: str | Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    column = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return column.isNotNull() & ~F.coalesce(bad, F.lit(False))


def whole(vector: str | Column) -> Column:
    """floor(256 c) of every entry c, as longs (beyond their range: the nearest long)."""
    column = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(column, lambda c: F.floor(c.cast("double") * 256).cast("long"))


def integer_vectors(rows: DataFrame, keep: tuple[str, ...], vector: str = "embedding") -> tuple[DataFrame, int]:
    """(the kept columns and ``x`` of the rows with a usable vector, the width).

    The width is that of the longest vector, 1 at least; shorter ones are filled up with zeros.
    """
    usable_rows = rows.where(usable(vector)).select(*keep, whole(vector).alias("x"))
    width = max(1, usable_rows.agg(F.max(F.size("x"))).first()[0] or 0)
    missing = F.lit(width) - F.size("x")
    filled = F.when(missing > 0, F.concat("x", F.array_repeat(F.lit(0).cast("long"), missing))).otherwise(F.col("x"))
    return usable_rows.withColumn("x", filled), width


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The rows of a list column, each of so many numbers."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):  # no chunk at all
        return np.zeros((0, width), np.int64)
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), width)


def lists(values: np.ndarray) -> pa.ListArray:
    """A list column from the rows of a matrix."""
    bounds = np.arange(values.shape[0] + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.ascontiguousarray(values).reshape(-1)))


def products(rows: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows with a vector; beyond a long the nearest long."""
    if not rows.size:
        return np.zeros(len(rows), np.int64)
    most = max(abs(int(rows.max())), abs(int(rows.min()))) * max(abs(int(other.max())), abs(int(other.min()))) * rows.shape[1]
    if most < EXACT:
        return np.rint(rows.astype(np.float64) @ other.astype(np.float64)).astype(np.int64)
    found = rows.astype(object) @ other.astype(object)
    return np.array([min(max(int(v), -(2**63)), 2**63 - 1) for v in found], np.int64)

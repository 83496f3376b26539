"""What the operators on embeddings share: which vectors count, and their form as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, all components finite."""
    big = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(F.exists(vector, big), F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def dense(df: DataFrame, column: str) -> DataFrame:
    """The column as array<double> where usable, with -0 as 0, and no other rows."""
    return df.where(usable(F.col(column))).withColumn(column, F.transform(column, lambda x: x.cast("double") + F.lit(0.0)))


def matrix(column: pa.Array | pa.ChunkedArray, idx: np.ndarray | None = None) -> np.ndarray:
    """Rows of equal width as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    if idx is not None:
        column = column.take(pa.array(idx))
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.empty((0, 0))


def by_width(column: pa.Array) -> list[np.ndarray]:
    """Row numbers, by width of the vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    width = np.diff(np.asarray(column.offsets))
    return [np.flatnonzero(width == w) for w in np.unique(width)]

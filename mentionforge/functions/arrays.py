"""Arrow list columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array | pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    """The given rows of a list column of equal widths."""
    part = column.take(pa.array(rows))
    if isinstance(part, pa.ChunkedArray):
        part = pa.concat_arrays(part.chunks)
    return part.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)

"""What the operators on embeddings share: sound rows, and whole components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def is_sound(vector: Column) -> Column:
    """Whether an array<double> is no null and holds finite values alone."""
    inf = F.lit(float("inf"))
    return vector.isNotNull() & F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)), F.lit(False))


def whole(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a double; no negative zero."""
    return F.transform(vector, lambda x: F.floor(x * F.lit(float(scale))).cast("double") + F.lit(0.0))


def matrix(column: pa.ListArray | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of a list column as a matrix; a shorter row ends in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = column.offsets.to_numpy()
    sizes = np.diff(ends)
    values = column.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]]
    if len(sizes) and (sizes == dims).all():
        return values.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], sizes)] = values
    return out

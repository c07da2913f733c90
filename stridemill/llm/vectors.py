"""Arrow lists of numbers as numpy matrices, and which vectors can be used."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Not null, and all components present and finite."""
    return F.col(f"`{vector}`").isNotNull() & F.forall(
        F.col(f"`{vector}`"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )


def lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All components as doubles, and the offsets of the rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    return values, np.r_[0, np.cumsum(lengths)].astype(np.int64)


def by_length(column: pa.Array | pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the vectors of each length."""
    values, offsets = lists(column)
    sizes = np.diff(offsets)
    out = {}
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        out[n] = rows, values[offsets[rows][:, None] + np.arange(n)]
    return out


def padded(column: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """One matrix with zeros behind shorter vectors, and the lengths."""
    values, offsets = lists(column)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(offsets[:-1], sizes)] = values
    return out, sizes

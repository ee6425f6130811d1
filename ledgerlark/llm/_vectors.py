"""Vectors in Arrow batches as numpy arrays, and which of them count."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

MOST = 1 << 25  #: of an integer component: squared distances of 2,048 of them fit in a long


def finite(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


def width(df: DataFrame, vector: str, parts: int = 1) -> int:
    """Components of the longest vector, up to a multiple of parts; 0 if there is none."""
    most = df.agg(F.max(F.size(vector))).first()[0] or 0
    return -(-most // parts) * parts


def matrix(column: pa.Array | pa.ChunkedArray, width: int, kind=np.float64) -> np.ndarray:
    """Lists as rows, shorter ones filled up with 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(size) * width and (size == width).all():
        return flat.astype(kind).reshape(-1, width)
    out = np.zeros((len(size), width), kind)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a matrix as lists."""
    n, wide = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * wide + 1, wide) if wide else np.zeros(n + 1), pa.int32()), pa.array(rows.reshape(-1), kind))

"""Integer vectors: components as whole numbers, Arrow lists as matrices, exact squared distances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WIDEST = 1 << 40  # components beyond it in either direction count as this
LONG = (1 << 63) - 1
EXACT = 2.0**53


def floors(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null for vectors that are null or hold null or non-finite ones."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    limit = float(WIDEST)

    def whole(x):
        return F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-limit)), F.lit(limit)))

    return F.when(vector.isNotNull() & ~odd, F.transform(vector, whole))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of an Arrow list column of integers, shorter ones padded with zeros to ``dim``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(np.asarray(column.offsets))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if (lengths == dim).all():
        return values.reshape(len(lengths), dim)
    out = np.zeros((len(lengths), dim), np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def doubles_hold(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether squared distances of rows of ``x`` and ``y`` are exact in doubles."""
    most = float(max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)))
    return 4 * x.shape[1] * most * most < EXACT


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` from all rows of ``y``, whatever the numbers' size."""
    if doubles_hold(x, y):
        x, y = x.astype(float), y.astype(float)
        return (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)
    x, y = x.astype(object), y.astype(object)
    out = np.empty((len(x), len(y)), object)
    for j, row in enumerate(y):
        out[:, j] = ((x - row) ** 2).sum(1)
    return out


def paired_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` from the same rows of ``y``."""
    kind = float if doubles_hold(x, y) else object
    return ((x.astype(kind) - y.astype(kind)) ** 2).sum(1)


def as_longs(numbers: np.ndarray) -> np.ndarray:
    """Whole numbers as 64 bits; larger ones become the largest."""
    if numbers.dtype == object:
        return np.array([min(int(n), LONG) for n in numbers], np.int64)
    return numbers.astype(np.int64)


def long_sum(column: str) -> Column:
    """The exact sum of longs, cut to the largest long."""
    total = F.sum(F.col(column).cast("decimal(38,0)"))
    return F.least(total, F.lit(LONG).cast("decimal(38,0)")).cast("long")

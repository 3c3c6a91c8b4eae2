"""Arrow list columns as numpy matrices, and top-k inside one batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Scores are compared after rounding to this many places: sums of doubles differ
# in their last bits with the order of addition.
PLACES = 6

# Numbers of vectors that a task works on at a time, whatever an Arrow batch holds.
ROW_CELLS = 1 << 18


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """A list column without nulls as a matrix, one row per list."""
    if len(column) == 0:
        return np.empty((0, 0), dtype)
    row_size(column)
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(dtype, copy=False)


def row_size(column: pa.Array) -> int:
    """How many numbers each list of a column holds, which must be the same for all."""
    size, rest = divmod(len(column.flatten()), len(column))
    if rest or (column.value_lengths().to_numpy(zero_copy_only=False) != size).any():
        raise ValueError("vectors of different sizes in one column")
    return size


def tiles(column: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of parts of a list column that hold about ``ROW_CELLS`` numbers each."""
    if len(column) == 0:
        return
    rows = max(1, ROW_CELLS // max(1, row_size(column)))
    for start in range(0, len(column), rows):
        yield start, min(rows, len(column) - start)


def list_array(rows: np.ndarray, value_type: pa.DataType) -> pa.ListArray:
    """A matrix as a list column, one list per row."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel(), type=value_type))


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; a zero row turns into NaN."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def best_rows(distances: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k nearest rows for each column of ``distances``.

    Order is (rounded distance, id). The two go into one whole number, so equal
    distances, as many copies of one vector have them, need no special case.
    NaN and infinity mean "not a candidate"; unused places hold -1.
    """
    n, width = distances.shape
    if n == 0:
        return np.full((0, width), -1)
    by_id = np.argsort(ids, kind="stable")
    # In place where it can be: each step would hold another array of this size.
    scaled = distances[by_id]
    unusable = ~np.isfinite(scaled)
    scaled[unusable] = 0.0
    scaled *= 10.0**PLACES
    keys = np.rint(scaled, out=scaled).astype(np.int64)
    del scaled
    keys *= n
    keys += np.arange(n)[:, None]
    last = np.iinfo(np.int64).max
    keys[unusable] = last
    k = min(k, n)
    chosen = np.argpartition(keys, k - 1, axis=0)[:k]
    found = by_id[chosen]
    found[np.take_along_axis(keys, chosen, axis=0) == last] = -1
    return found

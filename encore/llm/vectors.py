"""Vectors in Arrow batches: rows that can be used, and their components as whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Whole numbers beyond this do not fit the sums made of them.
MOST = 1 << 52


def scaled(column: pa.Array, factor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a list column without null or non-finite entries: their places, their lengths, and floor(factor * entry) of all their entries in a row.

    Entries are read as doubles, so a factor that is a power of two makes no rounding. A number beyond 2^52 is an error: no
    exact sum of such could be a long.
    """
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    bad = np.flatnonzero(~np.isfinite(values))
    fine = np.diff(np.searchsorted(bad, ends)) == 0
    if column.null_count:
        fine &= column.is_valid().to_numpy(zero_copy_only=False)
    numbers = np.floor(factor * values[np.repeat(fine, lengths)])
    if np.abs(numbers).max(initial=0) > MOST:
        raise ValueError(f"a component times {factor} is beyond 2^52")
    return np.flatnonzero(fine), lengths[fine], numbers.astype(np.int64)


def of_length(column: pa.Array, factor: int, length: int, shift: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places and matrix of the usable rows with exactly ``length`` entries, ``shift`` added to each number."""
    rows, lengths, numbers = scaled(column, factor)
    own = lengths == length
    return rows[own], numbers[np.repeat(own, lengths)].reshape(-1, length) + shift


def lists_of(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A list column of runs of ``values``, cut at ``ends`` (one more than lists)."""
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def lists(rows: np.ndarray) -> pa.Array:
    """A matrix as a list column, a list a row."""
    return lists_of(np.ascontiguousarray(rows).reshape(-1), np.arange(len(rows) + 1) * rows.shape[1])


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

"""Small helpers for Arrow-batched functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def long_lists(arrays: list[np.ndarray | None]) -> pa.Array:
    """A list<int64> array from one (u)int64 array per row; None gives NULL."""
    offsets = np.zeros(len(arrays) + 1, np.int32)
    if arrays:
        np.cumsum([0 if a is None else len(a) for a in arrays], out=offsets[1:])
    some = [a for a in arrays if a is not None]
    flat = np.concatenate(some) if some else np.empty(0, np.int64)
    flat = pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat.astype(np.int64))
    return pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array([a is None for a in arrays], pa.bool_()))


def list_values(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list<int64> array as uint64 arrays; empty for null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) == 0:
        return []
    flat = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    off = column.offsets.to_numpy()
    return [flat[off[i] : off[i + 1]] for i in range(len(column))]

"""Float vectors as exact integers: what the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Larger components would not fit: 64 squared differences of 2**28 are 2**62.
LARGEST = 1 << 27


def integer_lists(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """mask of the usable rows, their lengths, and all their components ``floor(scale * x)`` in one array.

    A row is usable if the list and all its components are given and finite.  Components
    beyond ``LARGEST`` raise ValueError, as scores and distances of them are not exact.
    """
    given = column.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(given, pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
    rows = np.repeat(np.arange(len(column)), sizes)
    finite = np.isfinite(values)
    mask = given.copy()
    mask[rows[~finite]] = False
    whole = np.floor(values[mask[rows]] * float(scale))
    if len(whole) and np.abs(whole).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST / scale}: products of it are not exact")
    return mask, sizes[mask], whole.astype(np.int64)


def as_lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType = pa.int32()) -> pa.ListArray:
    """Lists of the given lengths over one flat array."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values).cast(kind))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Lists of one length as a matrix of 64-bit integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices; as floats where these are exact, for speed."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)))
    most = a.shape[1] * int(np.abs(a).max()) * int(np.abs(b).max())
    if most < 1 << 53:
        return a.astype(np.float64) @ b.T.astype(np.float64)
    if most >= 1 << 62:
        raise ValueError("inner products do not fit 62 bits")
    return a @ b.T

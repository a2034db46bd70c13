"""Vector columns: which rows take part, and their entries as matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

#: Integers up to this size are exact as doubles.
EXACT = 1 << 53


def usable(vector: str) -> Column:
    """True where the vector is there and all its entries are finite numbers; an empty vector is."""
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, least: int = 1) -> np.ndarray:
    """The vectors as rows of doubles. Shorter ones end in zeros; there are `least` columns at least."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    lengths = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    d = max(least, int(lengths.max(initial=0)))
    if len(lengths) and (lengths == d).all():
        return values.reshape(-1, d)
    out = np.zeros((len(lengths), d))
    out[np.arange(d)[None, :] < lengths[:, None]] = values
    return out


def widened(x: np.ndarray, d: int) -> np.ndarray:
    return x if x.shape[1] >= d else np.pad(x, ((0, 0), (0, d - x.shape[1])))


def as_exact(x: np.ndarray, largest: float) -> np.ndarray:
    """Whole numbers as doubles where sums of products stay exact, that is below EXACT in size, else as Python's integers."""
    return x if largest < EXACT else np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)

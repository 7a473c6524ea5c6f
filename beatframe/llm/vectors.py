"""Vectors in Arrow batches: which take part, and as a matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

NUM = "array<double>"


def sound(col: str) -> Column:
    """Not null, with no null and no non-finite component."""
    v = F.col(col).cast(NUM)
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def matrix(col: pa.Array) -> np.ndarray:
    """Rows of doubles; shorter vectors are filled up with zeros."""
    size = col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    dim = int(size.max(initial=0))
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(flat) == dim * len(size):
        return flat.reshape(len(size), dim)
    out = np.zeros((len(size), dim))
    out[np.arange(dim)[None, :] < size[:, None]] = flat
    return out


def packed(m: np.ndarray) -> pa.Array:
    """Rows as binary values."""
    return pa.array([r.tobytes() for r in np.ascontiguousarray(m, np.float64)], pa.binary())


def unpacked(col) -> np.ndarray:
    rows = [np.frombuffer(x.as_buffer(), np.float64) for x in col]
    dim = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def widened(m: np.ndarray, dim: int) -> np.ndarray:
    return m if m.shape[1] >= dim else np.pad(m, ((0, 0), (0, dim - m.shape[1])))

"""Vector similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def round4(score: Column) -> Column:
    return F.floor(score * 10000 + 0.5) / 10000


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in doubles; 0 if either is empty or null, lengths differ or a norm is 0."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    add = lambda s, x: s + x
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), add)
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)) * F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, x: s + x * x))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (norm != 0), dot / F.when(norm != 0, norm)), F.lit(0.0))


def batch_cosine(column: pa.Array, query: np.ndarray) -> np.ndarray:
    """`cosine` of every vector of an Arrow list column with one query."""
    lengths = np.zeros(len(column), np.int64)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    lengths[valid] = (offsets[1:] - offsets[:-1])[valid]
    out = np.zeros(len(column))
    fit = np.flatnonzero((lengths == len(query)) & (len(query) > 0))
    if len(fit):
        values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
        m = values[offsets[fit][:, None] + np.arange(len(query))]
        norm = np.sqrt((m * m).sum(1)) * np.sqrt((query * query).sum())
        with np.errstate(invalid="ignore"):
            out[fit] = np.where(norm != 0, (m * query).sum(1) / np.where(norm != 0, norm, 1), 0)
    return out

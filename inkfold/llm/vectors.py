"""Embedding rows with whole-number components, and their matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether there is a vector and all of its components are finite numbers."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def whole(vector: Column) -> Column:
    """floor(256 * c) of every component, as array<bigint>."""
    return F.transform(vector, lambda v: F.floor(v.cast("double") * 256.0))


def padded(x: Column, size: int) -> Column:
    """With zeros behind shorter vectors."""
    return F.concat(x, F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.lit(size) - F.size(x), F.lit(0))))


def sizes(rows: DataFrame, vector: str) -> tuple[int, int]:
    """The smallest and the largest number of components; 0 and 0 without rows."""
    low, high = rows.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    return low or 0, high or 0


def matrix(column: pa.ListArray, width: int, kind=np.int64) -> np.ndarray:
    """Rows of `width` components: longer vectors are cut, shorter ones end in zeros."""
    bounds = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]]
    lengths = np.diff(bounds)
    if (lengths == width).all():
        return values.reshape(len(lengths), width).astype(kind, copy=False)
    out = np.zeros((len(lengths), width), kind)
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(values)) - np.repeat(bounds[:-1] - bounds[0], lengths)
    keep = at < width
    out[row[keep], at[keep]] = values[keep]
    return out

"""Vectors of an Arrow column as integer matrices, and exact sums of small tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integer components are below this, so that squared distances of 64 components fit 64 bits.
LARGEST = 1 << 27


def whole(vector: Column, dim: int) -> Column:
    """True for a vector of ``dim`` components, none of them null, NaN or infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & finite, F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    """The vector as integers: floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def integers(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, matrix) of the vectors that ``whole`` keeps, with floor(scale * x) components."""
    counts = np.asarray(pc.fill_null(pc.list_value_length(column), -1), np.int64)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    fits = counts == dim
    found = flat[np.repeat(fits, np.maximum(counts, 0))].reshape(-1, dim)
    # Null components have become NaN.
    kept = np.isfinite(found).all(axis=1)
    out = np.floor(found[kept] * scale)
    if out.size and np.abs(out).max() >= LARGEST:
        raise ValueError(f"a component times {scale} is {np.abs(out).max():.3g}; squared distances are exact below {LARGEST}")
    return np.flatnonzero(fits)[kept], out.astype(np.int64)


def totals(partial: DataFrame, *keys: str) -> list:
    """Rows of ``keys`` and their exact ``total``. The number of keys is the size of a model."""
    return partial.groupBy(*keys).agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()

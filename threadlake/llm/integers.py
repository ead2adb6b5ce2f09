"""Vector columns as matrices of whole numbers inside tasks, and exact sums over tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Whole numbers beyond this, far outside of what vectors hold, count as it.
LARGEST = 1 << 62


def usable(vectors: DataFrame, v: str) -> DataFrame:
    """Rows whose vector is not null and holds neither nulls nor values that are not finite."""
    return vectors.where(F.col(v).isNotNull()).where(F.forall(F.col(v).cast("array<double>"), lambda x: F.abs(x) < F.lit(float("inf"))))


def commonest_length(vectors: DataFrame, v: str) -> int:
    """The length that most vectors have, the larger of equals; 0 without rows."""
    row = vectors.groupBy(F.size(v).alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    return row["d"] if row else 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column whose rows all have that width, as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as int64; Python's integers in an object array decide where doubles do not hold the product exactly."""
    if not x.size or np.abs(x).max() < (1 << 50) / scale:
        return np.floor(scale * x).astype(np.int64)
    exact = [min(max(scale * n // d, -LARGEST), LARGEST) for n, d in (float(y).as_integer_ratio() for y in x.ravel())]
    return np.array(exact, np.int64).reshape(x.shape)


def fits(largest: int) -> bool:
    """Whether int64 holds sums up to this."""
    return largest < 1 << 62

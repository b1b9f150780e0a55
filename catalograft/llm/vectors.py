"""Vectors of a table as arrays; which of them take part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not zero, no null, infinite or NaN component."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(vector.isNotNull() & ~odd & some, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def fit_sample(rows: DataFrame, vector: str, most: int) -> np.ndarray:
    """At most `most` vectors, those of smallest hash: the same on every run."""
    picked = rows.select(F.col(vector).cast("array<double>").alias("v"))
    picked = picked.orderBy(F.xxhash64("v"), "v").limit(most).toArrow()
    return matrix(picked.column(0).combine_chunks()) if picked.num_rows else np.zeros((0, 0))

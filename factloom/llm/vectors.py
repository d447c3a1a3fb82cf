"""Vectors as the embedding operators take them: valid rows, blocks of rows in Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def valid(embedding: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    x = embedding.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def usable(df: DataFrame) -> DataFrame:
    return df.where(valid(F.col("embedding")))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of one length as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1).astype(np.float64) if n else np.zeros((0, 0))

"""Checked vectors as binary columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def lengths(frame: DataFrame, vector: str) -> list[int]:
    """The lengths that occur, ascending."""
    return sorted(r["d"] for r in frame.select(F.size(vector).alias("d")).distinct().collect())


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """Rows of a list column of one length, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, length)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; largest components first, so that nothing overflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows ** 2).sum(axis=1, keepdims=True))

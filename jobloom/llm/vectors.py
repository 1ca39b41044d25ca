"""Vectors as exact integers: which rows take part, and their matrices inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True for a vector without a null or non-finite component; false for a null one."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(sound(x), F.lit(False))), F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    """Each component x as the integer floor(scale * x), x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix.

    A component so large that a sum of squared differences could leave 64 bits raises: it has no exact result.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    out = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1 if rows else 0)
    largest = max(abs(int(out.max(initial=0))), abs(int(out.min(initial=0))))
    if out.shape[1] * (2 * largest) ** 2 >= 2**63:
        raise OverflowError(f"component {largest} is too large for exact 64-bit sums of {out.shape[1]} squares")
    return out


def with_columns_aside(df: DataFrame, **new: Column) -> DataFrame:
    """Only the columns ``new``, so that no name of ``df`` clashes with an operator's own."""
    return df.select(*[c.alias(n) for n, c in new.items()])

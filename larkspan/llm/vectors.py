"""Vectors of whole numbers from columns of numbers, and exact products of them. Used by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Doubles hold whole numbers up to this exactly.
EXACT = 1 << 53


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    x = vector.cast("array<double>")
    return vector.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def whole_vectors(df: DataFrame, vector: str, factor: int) -> DataFrame:
    """Rows whose vector is finite, with each component x as floor(factor * x), x as double."""
    scaled = F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda c: F.floor(F.lit(float(factor)) * c))
    return df.where(finite(F.col(f"`{vector}`"))).withColumn(vector, scaled)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a batch, a row each; ValueError if one hasn't `dim` components."""
    if len(column) and (np.diff(column.offsets.to_numpy()) != dim).any():
        raise ValueError(f"vectors have to have {dim} components each")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two matrices of whole numbers, exact: in doubles as long as these hold them, else in 64 bits.

    OverflowError beyond that.
    """
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < EXACT:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 61:
        return a @ b.T
    raise OverflowError("components are too large for products of 64 bits")

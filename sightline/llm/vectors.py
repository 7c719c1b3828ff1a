"""Vectors of the embedding operators as integers: floor(256 * x) of each component x, taken as a double."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components' size up to which inner products and squared distances of some thousand components are exact in doubles;
#: and up to which those of 64 components fit a long.
EXACT, LARGEST = 1 << 20, 1 << 27


def whole(vector: Column, size: int | None = None) -> Column:
    """The integer components as array<long>; null for a null vector, for one with a null or non-finite component, for
    an empty one, and for one of another size if a size is given. A component beyond LARGEST is an error."""
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    fits = F.coalesce(F.forall(vector, real), F.lit(False)) & (F.size(vector) == size if size else F.size(vector) > 0)
    scaled = lambda x: F.when(F.abs(256 * x.cast("double")) > LARGEST, F.raise_error("a component is too large for exact integer scores").cast("long")).otherwise(F.floor(256 * x.cast("double")))
    return F.when(fits, F.transform(vector, scaled))


def matrix(column) -> np.ndarray:
    """A pandas column of equally long arrays as a matrix of int64."""
    return np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.zeros((0, 0), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integer matrices, exact: in doubles where every partial sum is below 2**53, else in longs."""
    most = max(np.abs(a).max(initial=0), 1) * max(np.abs(b).max(initial=0), 1) * max(a.shape[-1], 1)
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def known(df: DataFrame, ident: str, vector: str, size: int | None = None) -> DataFrame:
    """df -> (ident, v): the rows that have a usable vector."""
    return df.select(F.col(ident), whole(F.col(vector), size).alias("v")).where(F.col("v").isNotNull())

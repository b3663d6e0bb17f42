"""What the operators on embeddings share: valid rows, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def is_valid(vector: Column) -> Column:
    """The vector isn't null and each of its entries is a finite number."""
    odd = F.exists(doubles(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(False))


def matrix(lists: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of a list column without nulls as a float64 matrix; entries that shorter rows lack are 0. dim: columns, else as many as the longest has."""
    lists = lists.cast(pa.list_(pa.float64()))
    off = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False)
    size = np.diff(off)
    dim = int(size.max(initial=0)) if dim is None else dim
    if len(size) and (size == dim).all():
        return values[off[0] : off[-1]].reshape(len(size), dim)
    out = np.zeros((len(size), dim))
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(off[-1] - off[0]) - np.repeat(off[:-1] - off[0], size)
    out[row, at] = values[off[0] : off[-1]]
    return out


def floored(m: np.ndarray, scale: float, most: int) -> np.ndarray:
    """floor(scale * x) as whole numbers, those beyond ``most`` held at it."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(m * scale), -float(most), float(most)).astype(np.int64)

"""Vectors as numpy arrays: which rows have one, and lists of any length as a padded matrix."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, vec array<double>) of rows whose vector is not null and holds only finite numbers."""
    vec = F.col(vec_col).cast("array<double>")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).where(vec.isNotNull() & ~bad)


def padded(col: pa.Array, width: int = 0) -> np.ndarray:
    """A list column as a matrix of doubles, as wide as its longest list (or ``width``); shorter ones end in zeros."""
    flat, size = col.flatten().to_numpy(zero_copy_only=False), col.value_lengths().to_numpy(zero_copy_only=False)
    width = max(width, int(size.max(initial=0)))
    if len(flat) == width * len(size):
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = flat
    return out

"""Vectors between Arrow and numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """Rows of a list column, all of one length, as a matrix."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1).astype(dtype, copy=False) if n else np.zeros((0, 0), dtype)


def vectors_of(df: DataFrame, item: str, vector: str, dims: int | None = None) -> DataFrame:
    """``(item long, vec array<float>)``; rows with a null id or vector, or with null elements, have no place among
    vectors and are left out; a vector of other than ``dims`` elements is an error."""
    v = F.col(vector)
    out = df.where(F.col(item).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull()))
    if dims is not None:
        wrong = F.raise_error(F.concat(F.lit(f"vector of other than {dims} elements: "), F.col(item)))
        v = F.when(F.size(v) == dims, v).otherwise(wrong)
    return out.select(F.col(item).cast("long").alias("item"), v.cast("array<float>").alias("vec"))


def collected(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of a bounded set of vectors, by id."""
    t = vectors.orderBy("item").toArrow().combine_chunks()
    if not t.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    column = t.column("vec").combine_chunks()
    return t.column("item").to_numpy(), matrix(column)

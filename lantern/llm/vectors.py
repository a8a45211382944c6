"""What the operators on vectors share: which rows take part, and vectors as bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vec: Column) -> Column:
    """True for a vector that is not null and whose components are all finite numbers."""
    return F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def vector_rows(df: DataFrame, id_col: str, vec_col: str, **extra: Column) -> DataFrame:
    """``id``, the extra columns and ``vec`` (doubles) of the rows that take part: those
    with an id, no null among the extra columns and a finite vector. Of rows that share an
    id the first by extra columns and vector stays, so repeated rows count once."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), *[c.alias(k) for k, c in extra.items()],
                     F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & finite(F.col("vec")))
    for k in extra:
        rows = rows.where(F.col(k).isNotNull())
    first = rows.groupBy("id").agg(F.min(F.struct(*extra, "vec")).alias("__row"))
    return first.select("id", "__row.*")


def dimensions(rows: DataFrame) -> int:
    """Components of the longest vector; shorter ones count as filled up with zeros."""
    return rows.agg(F.max(F.size("vec"))).first()[0] or 0


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of an Arrow list column as rows of ``dims`` doubles."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float)
    n = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    if (n == dims).all():
        return flat.reshape(len(n), dims)
    out = np.zeros((len(n), dims))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)

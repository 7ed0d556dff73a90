"""Shared pieces of the operators on vectors: which rows count, keys of equal vectors, Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True for a vector that is not null and holds neither null nor non-finite entries; never null."""
    whole = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & whole, F.lit(False))


def held(value: Column, bound: float) -> Column:
    """``value`` within plus or minus ``bound``."""
    return F.least(F.greatest(value, F.lit(-bound)), F.lit(bound))


def vector_key(vector: Column) -> Column:
    """SHA-256 of a vector's entries: a short join key that no two different vectors share."""
    return F.unhex(F.sha2(vector.cast("string"), 256))


def common_length(rows: DataFrame, vector: str, weight: str | None = None) -> tuple[int, int]:
    """The most frequent length of ``vector`` (the larger of two as frequent) and its rows, or weight; (0, 0) without rows."""
    times = F.sum(weight) if weight else F.count(F.lit(1))
    sizes = rows.filter(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).agg(times.alias("times"))
    top = sizes.orderBy(F.desc("times"), F.desc("d")).first()
    return (top["d"], top["times"]) if top else (0, 0)


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """A list column whose rows are all of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind, copy=False)


def whole(table: pa.Table, name: str) -> pa.Array:
    """One column of a group as one array."""
    chunks = table.column(name).chunks
    return chunks[0] if len(chunks) == 1 else pa.concat_arrays(chunks)

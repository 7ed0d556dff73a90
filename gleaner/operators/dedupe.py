"""Keep one row per key. A hot key costs nothing extra: each map task sends on at most one row of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key by ``order``; a missing key is a group of its own.

    ``row_number() = 1`` is planned with a group limit before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key by ``order``, nulls counting as earliest.

    Give an order that leaves no ties, such as (snapshot, row position), or the choice among them is
    not repeatable.
    """
    return keep_first(df, keys, [F.desc_nulls_last(c) for c in order])


def latest_by(df: DataFrame, key: str, value_columns: list[str], order: list[str]) -> DataFrame:
    """As ``keep_last`` but as an aggregate, for streams and for merging into other aggregates."""
    rest = F.struct(*value_columns)
    return df.groupBy(key).agg(F.max_by(rest, F.struct(*order)).alias("_row")).select(key, "_row.*")


def distinct_elements(c: Column | str) -> Column:
    return F.array_distinct(c)

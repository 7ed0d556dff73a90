"""Row filters that reach the scan, and record lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns)


def _moment(df: DataFrame, column: str, text: str) -> Column:
    """A literal of the column's own type, so that the comparison is pushed to the files."""
    return F.lit(text).cast(df.schema[column].dataType)


def since(df: DataFrame, column: str, day: str) -> DataFrame:
    return df.filter(F.col(column) >= _moment(df, column, day))


def since_flags(df: DataFrame, column: str, days: dict[str, str]) -> DataFrame:
    """One boolean per named day; a missing date gives false."""
    return df.withColumns({
        name: F.coalesce(F.col(column) >= _moment(df, column, day), F.lit(False)) for name, day in days.items()
    })


def find_one(df: DataFrame, key: str, value: object, order: str) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value)).orderBy(order).limit(1)


def default_zero(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0))


def profile(
    title: Column, place: Column, years: Column, days: Column, max_years: int = 7, max_days: int = 45,
    industries: Column | None = None,
) -> Column:
    """Right title, right place, not too senior, not too old, and if given the right industry."""
    test = title & place & (default_zero(years) < max_years) & (default_zero(days) <= max_days)
    return test if industries is None else test & industries


def is_member(df: DataFrame, column: str, items: dict[str, str]) -> DataFrame:
    """Whether each item occurs in any row's list; one row, one boolean per item."""
    return df.agg(*[
        F.coalesce(F.bool_or(F.array_contains(column, item)), F.lit(False)).alias(name) for name, item in items.items()
    ])


def record_profile(df: DataFrame, key: str) -> DataFrame:
    """Records turned on their side: (key, field, value), missing values left out."""
    fields = [c for c in df.columns if c != key]
    texts = df.select(key, *[F.col(c).cast("string").alias(c) for c in fields])
    return texts.unpivot(key, fields, "field", "value").filter(F.col("value").isNotNull())

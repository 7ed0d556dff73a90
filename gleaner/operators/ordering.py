"""Sorts and limits. Every order ends in a unique key, which also lets a range sort split equal values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.plans.ordered import kth_row


def newest_first(df: DataFrame, date: str, tie: str, columns: list[str] | None = None) -> DataFrame:
    """Newest first, missing dates last."""
    out = df.orderBy(F.desc_nulls_last(date), F.asc(tie))
    return out.select(*columns) if columns else out


def flags_first(df: DataFrame, flags: list[str], tie: list[str]) -> DataFrame:
    """Rows with more leading flags first; ``tie`` is the order before, which a stable sort keeps."""
    return df.orderBy(*[F.desc(f) for f in flags], *tie)


def head(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def nth_match(df: DataFrame, mask: Column, order: str, index: int) -> DataFrame:
    """The row at ``index`` (0-based) among the matches; an index past the end wraps around."""
    return kth_row(df, F.coalesce(mask, F.lit(False)), order, index)

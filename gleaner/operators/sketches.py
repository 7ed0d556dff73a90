"""Distinct counts over any span of days from one stored sketch per day and group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 14


def error_bound(lg_k: int = LG_K, deviations: float = 4.0) -> float:
    """Relative error that an estimate stays within, at so many standard deviations."""
    return deviations * 1.04 / math.sqrt(2**lg_k)


def daily_sketches(df: DataFrame, groups: list[str], key: str, lg_k: int = LG_K) -> DataFrame:
    """(groups, n_rows, sketch): rows and the distinct non-null keys of each group, such as a day and a query.

    Map tasks send one sketch per group, of at most ``2**lg_k`` bytes or so, whatever its rows.
    """
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_rows"), F.hll_sketch_agg(key, lg_k).alias("sketch"))


def merged_counts(sketches: DataFrame, groups: list[str | Column]) -> DataFrame:
    """(groups, n_rows, n_keys): stored sketches merged over days, without reading the rows again.

    ``n_keys`` is an estimate; ``exact_counts`` is the other form.
    """
    return sketches.groupBy(*groups).agg(
        F.sum("n_rows").alias("n_rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_keys")
    )


def exact_counts(df: DataFrame, groups: list[str | Column], key: str) -> DataFrame:
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"))

"""How key sets overlap, and set algebra on keys.

All of it starts from one table of membership flags, so the big sides shuffle once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.joins import membership_flags


def exclusive_regions(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys that lie in exactly the flagged sets: at most 2^k rows.

    That this form counts exclusively is an assumption.
    """
    return membership_flags(sources, key).groupBy(*sources).agg(F.count(F.lit(1)).alias("size"))


def _percent(df: DataFrame, union: Column) -> DataFrame:
    return df.withColumn("percent", F.round(F.lit(100.0) * F.col("size") / union, 1))


def set_overlap(sources: dict[str, DataFrame], key: str, chosen: list[list[str]] | None = None) -> DataFrame:
    """Inclusive intersection size of every combination of sets, and its percent of the union.

    The row without any ``Yes`` is the union. Each observed region counts for all subsets of its sets, so
    combinations no key is in do not show, whatever the number of sets; ``chosen`` names combinations.
    """
    names = list(sources)
    regions = exclusive_regions(sources, key)
    union = regions.agg(F.sum("size").alias("_union")).scalar()
    if chosen is not None:
        return _percent(_chosen(regions, names, chosen), union)
    held = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]))
    kind = "array<array<string>>"
    subsets = F.aggregate(
        held,
        F.array(F.array().cast("array<string>")).cast(kind),
        lambda found, n: F.concat(found, F.transform(found, lambda s: F.concat(s, F.array(n)))).cast(kind),
    )
    inclusive = regions.select("size", F.explode(subsets).alias("combo")).groupBy("combo").agg(F.sum("size").alias("size"))
    shown = [F.when(F.array_contains("combo", n), F.lit("Yes")).otherwise(F.lit("-")).alias(n) for n in names]
    return _percent(inclusive.select(*shown, "size"), union)


def _chosen(regions: DataFrame, names: list[str], chosen: list[list[str]]) -> DataFrame:
    def hit(combo: list[str]) -> Column:
        return reduce(lambda x, y: x & y, [F.col(n) for n in combo], F.lit(True))

    rows = [
        F.struct(
            *[F.lit("Yes" if n in combo else "-").alias(n) for n in names],
            F.coalesce(F.sum(F.when(hit(combo), F.col("size"))), F.lit(0)).alias("size"),
        )
        for combo in chosen
    ]
    return regions.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def intersect_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return membership_flags({"_a": a, "_b": b}, key).filter(F.col("_a") & F.col("_b")).select(key)


def union_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).unionByName(b.select(key)).distinct()


def except_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return membership_flags({"_a": a, "_b": b}, key).filter(F.col("_a") & ~F.col("_b")).select(key)


def keys_of_mask(df: DataFrame, mask: Column, key: str) -> DataFrame:
    """Distinct keys of the rows that match."""
    return df.filter(mask).select(key).distinct()


def union_snapshots(parts: list[DataFrame], distinct: bool = False) -> DataFrame:
    """Concatenate by column name; a column some snapshot lacks is null there."""
    out = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    return out.distinct() if distinct else out

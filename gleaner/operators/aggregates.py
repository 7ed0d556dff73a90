"""Summaries: counts, shares, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

OTHER = "(Other)"


def _with_other(counts: DataFrame, n: int | None, cutoff: int | None, base: Column | int | None) -> DataFrame:
    """Top of a (value, N) table and one ``(Other)`` row. Both read one exchange of the counts.

    A null value is no value: its N may carry the number of rows, which ``base`` then asks for.
    """
    kept = counts.filter(F.col("value").isNotNull())
    totals = counts.agg(F.struct(
        F.sum(F.when(F.col("value").isNotNull(), F.col("N"))).alias("all"),
        F.max(F.when(F.col("value").isNull(), F.col("N"))).alias("rows"), F.count("value").alias("values"),
    ).alias("_totals")).scalar()
    if n is not None:
        # a null test ahead of the limit would sink below the aggregate and make its exchange a second one
        top = counts.orderBy(F.col("value").isNull(), F.desc("N"), F.asc("value")).limit(n)
        top = top.filter(F.col("value").isNotNull())
        # n rows, already in one task
        whole = Window.partitionBy(F.lit(0)).orderBy(F.desc("N"), F.asc("value"))
        frame = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        numbered = top.withColumns({
            "_is_last": F.row_number().over(whole) == F.count(F.lit(1)).over(frame), "_t": totals, "_sum": F.sum("N").over(frame),
        }).withColumn("_rest", F.col("_t.all") - F.col("_sum"))
        row = F.struct(F.col("value"), F.col("N"))
        other = F.struct(F.lit(OTHER).alias("value"), F.col("_rest").alias("N"))
        pair = F.when(F.col("_is_last") & (F.col("_rest") > 0), F.array(row, other)).otherwise(F.array(row))
        listed = numbered.select(F.inline(pair))
    elif cutoff is not None:
        low = kept.filter(F.col("N") < cutoff).agg(F.sum("N").alias("N")).filter(F.col("N") > 0)
        listed = kept.filter(F.col("N") >= cutoff).unionByName(low.select(F.lit(OTHER).alias("value"), "N"))
    else:
        listed = kept
    if base is None:
        base = totals["all"]
    elif isinstance(base, str):
        base = totals[base]
    elif isinstance(base, int):
        base = F.lit(base)
    return listed.withColumn("percent", F.round(F.lit(100.0) * F.col("N") / base, 1))


def value_counts(
    df: DataFrame, column: str, n: int | None = 10, cutoff: int | None = None, vmax: Column | int | str | None = None
) -> DataFrame:
    """Top values of a column as (value, N, percent), then one ``(Other)`` row with the rest.

    ``n`` keeps that many values, ``cutoff`` (used when ``n`` is None) those that occur at least that
    often. ``percent`` is of ``vmax``, by default of all counted values, with "values" of the distinct ones. Nulls are not
    counted. Equal counts are ordered by value.
    """
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(column).alias("N"))
    return _with_other(counts, n, cutoff, vmax)


def exploded_counts(df: DataFrame, column: str, n: int | None = 10, cutoff: int | None = None) -> DataFrame:
    """``value_counts`` over the elements of a list column; percent is of the rows, so it may pass 100.

    Every row also gives one null element, so the same pass counts the rows.
    """
    items = F.filter(F.coalesce(F.col(column), F.array().cast(df.schema[column].dataType)), lambda x: x.isNotNull())
    marked = F.concat(F.array(F.lit(None).cast(df.schema[column].dataType.elementType)), items)
    elements = df.select(F.explode(marked).alias("value")).select(F.col("value").cast("string"))
    counts = elements.groupBy("value").agg(F.count(F.lit(1)).alias("N"))
    return _with_other(counts, n, cutoff, "rows")


def share_true(df: DataFrame, mask: Column, with_false: bool = False) -> DataFrame:
    """(N, total, percent) of a mask; a null counts as not true."""
    hits = F.count_if(F.coalesce(mask, F.lit(False)))
    total = F.count(F.lit(1))
    false = [F.count_if(~mask).alias("n_false")] if with_false else []
    return df.agg(hits.alias("N"), *false, total.alias("total"), F.round(F.lit(100.0) * hits / total, 4).alias("percent"))


def count_and_distinct(df: DataFrame, group: str, key: str, all_label: str = "ALL") -> DataFrame:
    """Rows and distinct keys, per group and overall, in one job."""
    return (
        df.rollup(group)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"), F.grouping(group).alias("_g"))
        .select(F.when(F.col("_g") == 1, F.lit(all_label)).otherwise(F.col(group)).alias(group), "n_rows", "n_keys")
    )


def nunique_all(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct values of every column; ``approximate`` needs no shuffle of the values."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(c).alias(c) for c in columns or df.columns])


def any_match(df: DataFrame, mask: Column, out: str = "found") -> DataFrame:
    return df.agg(F.coalesce(F.bool_or(mask), F.lit(False)).alias(out))


def newest(df: DataFrame, column: str) -> Column:
    """The newest value of a table as a scalar subquery: one small aggregate, no join."""
    return df.agg(F.max(column).alias("_newest")).scalar()


def company_rollup(df: DataFrame, company: str = "company", order: str = "hash") -> DataFrame:
    """Scalar measures per company. Partial aggregation folds a hot company before the shuffle.

    The list columns are in ``company_lists``, a row per value, since a group may be too large for one row.
    """
    return df.groupBy(company).agg(
        F.count(F.lit(1)).alias("n_jobs"),
        F.min_by("company_summary", order).alias("company_summary"),
        F.floor(F.min("hours") / 24).alias("days"),
        F.min("lower").alias("lower"),
        F.round(F.avg("median"), 2).alias("median"),
        F.max("upper").alias("upper"),
    )


def company_lists(df: DataFrame, columns: list[str], company: str = "company") -> DataFrame:
    """(company, field, value, n): the distinct values of each column per company, and in how many entries.

    One shape whatever the size: how the lists of one company merge is an assumption, read as the distinct union.
    A list column counts each element; nulls are left out. All columns take one scan and one aggregation,
    whose partial counts fold a hot company before the shuffle.
    """
    def entries(column: str) -> Column:
        is_list = isinstance(df.schema[column].dataType, ArrayType)
        values = F.coalesce(F.col(column), F.array().cast(df.schema[column].dataType)) if is_list else F.array(column)
        return F.transform(values, lambda v: F.struct(F.lit(column).alias("field"), v.cast("string").alias("value")))

    entry = F.explode(F.concat(*[entries(c) for c in columns])).alias("e")
    rows = df.select(company, entry).select(company, "e.field", "e.value").filter("value is not null")
    return rows.groupBy(company, "field", "value").agg(F.count(F.lit(1)).alias("n"))


def with_size(df: DataFrame, payload: str, out: str = "dsize") -> DataFrame:
    """Bytes of a payload column."""
    return df.withColumn(out, F.octet_length(payload).cast("bigint"))

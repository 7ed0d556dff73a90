"""Row order over distributed data without sorting a whole key, or the whole table, in one task.

The rows are cut into slices of about equal depth along the order column, whatever the key, as many as the
number of rows asks for: no slice of any key holds much more than ``1 / slices`` of all rows, even where one
key, or one day, holds a third of them. Rows without an order value have the first slice, as an ascending order
puts nulls first. Work happens inside (key, slice); what must cross a border travels through a table with one row per
(key, slice). The join back uses the same keys, so it needs no further shuffle of the rows. Only many
rows with the same value of the order column, or without one, stay together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.session import scratch_path

#: rows of a slice, and the most slices: their borders come to the driver
SLICE_ROWS = 500_000
MOST_SLICES = 10_000
_INF = float("inf")


def order_number(df: DataFrame, column: str) -> Column:
    """An order column as a double that never reverses the order."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.DateType):
        return F.date_diff(c, F.lit("1970-01-01").cast("date")).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        span = c - F.lit("1970-01-01 00:00:00").cast(kind)
        parts = {"DAY": 86400, "HOUR": 3600, "MINUTE": 60, "SECOND": 1}
        return sum((F.extract(F.lit(p), span).cast("double") * n for p, n in parts.items()), F.lit(0.0))
    return c.cast("double")


def borders_of(df: DataFrame, column: str, slices: int | None = None) -> list[float]:
    """Values that cut the rows into slices of about equal depth: one count, one pass over one column, at most
    ``slices - 1`` numbers come back. Without ``slices`` a slice has about ``SLICE_ROWS`` rows."""
    if slices is None:
        slices = min(MOST_SLICES, -(-df.count() // SLICE_ROWS))
    if slices <= 1:
        return []
    points = [i / slices for i in range(1, slices)]
    found = df.agg(F.percentile_approx(order_number(df, column), points, 20 * slices)).first()[0]
    return sorted(set(found or []))


def with_slice(df: DataFrame, column: str, borders: list[float], out: str = "_slice") -> DataFrame:
    """Slice number of each row by binary search; -1 for a row without a value."""
    number = f"{out}_number"
    splits = [-_INF, *borders, _INF] if borders else [-_INF, 0.0, _INF]
    cut = Bucketizer(splits=splits, inputCol=number, outputCol=out, handleInvalid="keep")
    placed = cut.transform(df.withColumn(number, order_number(df, column)))
    return placed.withColumn(out, F.when(F.col(number).isNull(), -1).otherwise(F.col(out).cast("int"))).drop(number)


def lead_value(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, slices: int | None = None) -> DataFrame:
    """``lead(value)`` over ``order`` within ``keys``; null on the last row of a key."""
    rows = with_slice(df, order[0], borders_of(df, order[0], slices))
    cell = [*keys, "_slice"]
    boxed = F.struct(F.col(value).alias("v"))
    firsts = (
        rows.groupBy(*cell).agg(F.min_by(boxed, F.struct(*order)).alias("_first"))
        .withColumn("_carry", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_slice")))
        .select(*cell, "_carry")
    )
    led = rows.withColumn("_next", F.lead(boxed).over(Window.partitionBy(*cell).orderBy(*order)))
    joined = led.join(firsts, cell, "left")
    return joined.withColumn(out, F.coalesce("_next", "_carry")["v"]).drop("_slice", "_next", "_carry")


def running_count(df: DataFrame, keys: list[str], order: list[str], test: Column, out: str, slices: int | None = None) -> DataFrame:
    """How many rows up to and including this one pass ``test``, by ``order`` within ``keys``."""
    rows = with_slice(df, order[0], borders_of(df, order[0], slices))
    rows = rows.withColumn("_hit", F.coalesce(test, F.lit(False)).cast("long"))
    cell = [*keys, "_slice"]
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*cell).agg(F.sum("_hit").alias("_hits"))
        .withColumn("_offset", F.coalesce(F.sum("_hits").over(before), F.lit(0)))
        .select(*cell, "_offset")
    )
    inner = Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("_run", F.sum("_hit").over(inner))
    return (
        counted.join(offsets, cell, "left")
        .withColumn(out, F.col("_run") + F.col("_offset"))
        .drop("_slice", "_hit", "_run", "_offset")
    )


def forward_value(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, slices: int | None = None) -> DataFrame:
    """Last value seen so far, the row's own included, by ``order`` within ``keys``; null before the first one."""
    rows = with_slice(df, order[0], borders_of(df, order[0], slices))
    cell = [*keys, "_slice"]
    upto = Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.when(F.col(value).isNotNull(), F.struct(*order))  # null orders are left out by max_by
    carried = (
        rows.groupBy(*cell).agg(F.max_by(value, seen).alias("_last"))
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(before)).select(*cell, "_carry")
    )
    filled = rows.withColumn("_own", F.last(value, ignorenulls=True).over(upto))
    tests = [filled[c].eqNullSafe(carried[c]) for c in cell]
    joined = filled.join(carried, reduce(lambda x, y: x & y, tests), "left")
    return joined.select(*[filled[c] for c in df.columns if c != out], F.coalesce("_own", "_carry").alias(out))


def kth_row(df: DataFrame, mask: Column, order: str, index: int, slices: int | None = None, levels: int = 2) -> DataFrame:
    """The row at ``index`` (0-based, wrapping around) among the rows that pass ``mask``.

    ``order`` is a unique numeric or date column. The order values of the matches are written once, which is all that the
    mask is evaluated for; the rest reads that one column. Each level cuts it into slices, counts them, and
    goes on with the slice that holds the wanted row; the driver sees the borders and the counts. The last sort takes in
    about ``1 / slices ** levels`` of the matches, or one slice's. The row itself is looked up by its order value.
    Borders may be inexact, the result is not.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "matches")
    df.filter(mask).select(order).write.parquet(path)
    within = spark.read.schema(df.select(order).schema).parquet(path)
    nth, total = None, None
    for _ in range(levels):
        cut = with_slice(within, order, borders_of(within, order, slices))
        counts = dict(cut.groupBy("_slice").agg(F.count(F.lit(1))).collect())
        if nth is None:
            total = sum(counts.values())
            if not total:
                return df.limit(0).withColumns({"position": F.lit(0).cast("bigint"), "n_matches": F.lit(0).cast("bigint")})
            nth = index % total + 1
        for wanted in sorted(counts):
            if nth <= counts[wanted]:
                break
            nth -= counts[wanted]
        within = cut.filter(F.col("_slice") == wanted).drop("_slice")
    value = within.orderBy(order).limit(nth).orderBy(F.desc(order)).first()[0]
    hit = df.filter(F.col(order).eqNullSafe(F.lit(value)))
    return hit.withColumns({"position": F.lit(index % total + 1).cast("bigint"), "n_matches": F.lit(total).cast("bigint")})

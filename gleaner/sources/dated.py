"""A Parquet table of dated snapshots: a day is replaced as a whole, whichever order days arrive in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.dedupe import keep_last


def write_days(rows: DataFrame, store: str, day: str, gathered: bool = False) -> None:
    """Replace the days that ``rows`` hold, and only those; a day written again leaves the same rows.

    The rebalance hint gathers a day into few files and lets adaptive execution split a large one, by packed bytes. A
    task sorts all its rows by day, so wide rows that pack well are better dealt ahead: ``gathered`` rows, which lie by
    day already, are written where they are. Rows without a day share a folder of their own.
    """
    if not gathered:
        rows = rows.hint("rebalance", day)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(store)


def read_days(spark: SparkSession, store: str, day: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """The stored rows; days outside ``since`` .. ``until`` (both included) are pruned from the scan."""
    rows = spark.read.parquet(store)
    if since is not None:
        rows = rows.filter(F.col(day) >= F.lit(since).cast("date"))
    if until is not None:
        rows = rows.filter(F.col(day) <= F.lit(until).cast("date"))
    return rows


def last_seen(
    spark: SparkSession, store: str, keys: list[str], day: str, order: list[str] | None = None,
    since: str | None = None, until: str | None = None,
) -> DataFrame:
    """The reconciled view: each key as its last day has it, ties within a day by ``order``."""
    return keep_last(read_days(spark, store, day, since, until), keys, [day, *(order or [])])

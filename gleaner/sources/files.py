"""Text, CSV and file listings."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import key_from_log


def reference_list(spark: SparkSession, path: str, column: str | None = None, comment: str = "#") -> DataFrame:
    """One-column CSV with a header; rows that start with the comment mark are left out."""
    df = spark.read.csv(path, header=True)
    name = column or df.columns[0]
    return df.select(F.col(f"`{name}`").alias(name)).filter(~F.col(f"`{name}`").startswith(comment))


def write_distinct_csv(df: DataFrame, column: str, path: str) -> None:
    """Distinct elements of a list column as a headless CSV."""
    df.select(F.explode(column).alias(column)).distinct().write.mode("overwrite").csv(path, header=False)


def write_identifiers(df: DataFrame, position: str, key: str, path: str) -> None:
    """``position.key`` lines."""
    df.select(F.concat(F.col(position), F.lit("."), F.col(key).cast("string"))).write.mode("overwrite").text(path)


def skipped_keys(lines: DataFrame, column: str = "value", prefix: str = "Skip") -> DataFrame:
    """Keys of the log lines that start with ``prefix``."""
    return lines.filter(F.col(column).startswith(prefix)).select(key_from_log(column).alias("hash"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def snapshot_scan(spark: SparkSession, root: str, glob: str = "*.html", whole: bool = True) -> DataFrame:
    """Dated snapshots below ``root/{date}/{query}/`` as (snapshot_date, query, path, value).

    One scan takes in all dates; ``glob`` picks files by name, such as one query's, while listing.
    Folder names may carry a ``column=`` part. ``whole=False`` gives a row per line, so that a large
    listing needs no row of its own size.
    """
    reader = (
        spark.read.format("text").option("wholetext", whole).option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
    )
    path = F.col("_metadata.file_path")
    return reader.load(root).select(
        F.try_to_date(F.regexp_extract(path, r"/(?:[^/=]+=)?(\d{4}-\d{2}-\d{2})/", 1)).alias("snapshot_date"),
        F.regexp_extract(path, r"/(?:[^/=]+=)?([^/]+)/[^/]+$", 1).alias("query"),
        path.alias("path"),
        "value",
    )


def stem(path: Column | str) -> Column:
    """File name without its last extension."""
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def file_name(path: Column | str) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return F.substring_index(path, "/", -1)


def file_inventory(
    spark: SparkSession, root: str, glob: str = "*", since: int | str | datetime | None = None
) -> DataFrame:
    """(path, size, mtime) of the files below ``root``; contents are never read.

    ``since`` is a number of days back from now, or the earliest time to keep. The listing applies it.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    if isinstance(since, int):
        since = datetime.now() - timedelta(days=since)
    df = reader.load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    if since is not None:
        df = df.filter(F.col("mtime") >= F.lit(since).cast("timestamp"))
    return df


def folder_inventory(inventory: DataFrame) -> DataFrame:
    """(path, size, mtime) of the folders that hold the files: a table written by many tasks counts once, as of its newest part."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return inventory.groupBy(folder.alias("path")).agg(F.sum("size").alias("size"), F.max("mtime").alias("mtime"))


def by_recency(inventory: DataFrame) -> DataFrame:
    """Newest file or folder first, equal times by path."""
    return inventory.orderBy(F.desc("mtime"), F.asc("path"))


def name_check(df: DataFrame, name: str, store: str) -> DataFrame:
    """Rows against distinct names of one store."""
    return df.agg(
        F.lit(store).alias("store"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct(name).alias("n_names")
    )


def nonempty(df: DataFrame, size: Column | str, more_than: int = 5) -> DataFrame:
    size = F.col(size) if isinstance(size, str) else size
    return df.filter(size > more_than)

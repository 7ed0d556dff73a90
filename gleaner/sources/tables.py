"""Tables: scans, materialised results, payloads by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, name_or_path: str) -> DataFrame:
    """A catalog table by name, or Parquet by path."""
    if "/" in name_or_path:
        return spark.read.parquet(name_or_path)
    return spark.table(name_or_path)


def sql_on_file(spark: SparkSession, path: str, select: str = "*") -> DataFrame:
    """SQL straight on a Parquet file or folder."""
    quoted = path.replace("`", "``")
    return spark.sql(f"SELECT {select} FROM parquet.`{quoted}`")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever file system it names."""
    try:
        spark.read.format("binaryFile").load(path).schema  # resolved now, on a Connect session too
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def cached_parquet(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], overwrite: bool = False
) -> DataFrame:
    """Read the result at ``path``; build and write it first when absent or when ``overwrite``.

    Only a folder with a success mark counts, so a job that died half-way is built again.
    """
    if overwrite or not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def payload_by_key(df: DataFrame, key: str, value: object, payload: str, stamp: str) -> DataFrame:
    """The newest stored payload of one key; no row when there is none."""
    return df.filter(F.col(key) == F.lit(value)).orderBy(F.desc_nulls_last(stamp), F.asc(payload)).limit(1)


def consolidate(df: DataFrame, path: str) -> DataFrame:
    """Compact many small payloads into files of even size.

    The rebalance hint lets adaptive execution choose the number of files from the bytes it sees, and
    split what is too large.
    """
    df.hint("rebalance").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt over ``spark.sql.shuffle.partitions`` tasks, ahead of work that costs far more than reading them.

    A small file is one task, and a file is cut only between its row groups, whatever the work on its rows.
    The number is given, so that adaptive execution, which goes by bytes, does not gather them again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

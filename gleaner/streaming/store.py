"""Folders of a stored stream: one per run of a checkpoint and batch, so no run ever writes over another's rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKS = ("run", "batch_id")


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a checkpoint keeps over restarts; a new checkpoint has a new one."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def write_batch(rows: DataFrame, store: str, run: str, number: int, by: str | None = None) -> None:
    """Replace this run's batch, and only that, so a batch that runs again leaves the same rows."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(f"{store}/run={run}/batch_id={number}")


def other_batches(stored: DataFrame, run: str, number: int) -> DataFrame:
    """All stored rows but those of this run's batch."""
    return stored.filter(~((F.col("run") == run) & (F.col("batch_id") == number)))

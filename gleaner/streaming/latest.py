"""Keep the last version of each key over snapshots that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators.dedupe import keep_last
from gleaner.streaming.store import MARKS, run_id, write_batch


def upsert_latest(
    stream: DataFrame, key: str, order: list[str], store: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append the last version per key of each batch; ``read_latest`` resolves versions across batches.

    A batch writes only its own rows, never the whole table again, and replaces its own folder when it
    runs again. Folders carry the checkpoint's id, so a new checkpoint adds to what is stored.
    """

    def write(batch: DataFrame, number: int) -> None:
        write_batch(keep_last(batch, [key], order), store, run_id(batch.sparkSession, checkpoint), number)

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def read_latest(spark: SparkSession, store: str, key: str, order: list[str]) -> DataFrame:
    return keep_last(spark.read.parquet(store), [key], order).drop(*MARKS)


def compact_latest(spark: SparkSession, store: str, key: str, order: list[str], target: str) -> DataFrame:
    """Write the resolved table to a new folder, for a job that runs now and then."""
    read_latest(spark, store, key, order).hint("rebalance").write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)

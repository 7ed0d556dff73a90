"""Emit each key once over snapshots that keep arriving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators.dedupe import keep_first
from gleaner.sources.tables import path_exists
from gleaner.streaming.store import MARKS, other_batches, run_id, write_batch

BUCKET = "_bucket"
BUCKETS = 64


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _bucket_schema(kind: str, key: str) -> str:
    return f"`{key}` {kind}, run string, batch_id bigint, {BUCKET} int"


def stored_keys(spark: SparkSession, store: str, key: str, kind: str, buckets: list[int]) -> DataFrame:
    """The stored keys of some buckets; folders of other buckets are pruned, and no other column is read."""
    known = spark.read.schema(_bucket_schema(kind, key)).parquet(store)
    return known.filter(F.col(BUCKET).isin(buckets))


def first_seen(
    stream: DataFrame, key: str, order: list[str], store: str, checkpoint: str, trigger: dict | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Append the first row of every key not stored yet to the Parquet table ``store``.

    Each batch goes to a folder of its own, named by the checkpoint's id and the batch number, and compares with all
    other folders: a batch that runs again after a lost executor writes the same rows, once, and a new
    checkpoint adds to what is stored. No state is kept in memory. Keys lie in folders by hash, of which a batch reads
    those that its own keys fall in. Stored keys are met with the batch's by a semi join, whose small side is the batch,
    so that only keys that come again are shuffled. ``buckets`` must stay the same for one store; a null key counts as
    a key like any other. ``compact_first_seen`` gathers the folders of many batches.
    """

    def write(batch: DataFrame, number: int) -> None:
        fresh = keep_first(batch, [key], [F.asc_nulls_last(c) for c in order]).withColumn(BUCKET, bucket_of(key, buckets))
        spark = batch.sparkSession
        run = run_id(spark, checkpoint)
        if not path_exists(spark, store):
            write_batch(fresh.repartition(BUCKET), store, run, number, BUCKET)
            return
        fresh = fresh.persist()
        try:
            touched = [r[0] for r in fresh.select(BUCKET).distinct().collect()]  # at most ``buckets`` numbers
            known = other_batches(stored_keys(spark, store, key, batch.schema[key].dataType.simpleString(), touched), run, number)
            again = known.alias("k").join(fresh.select(key).alias("f"), F.col(f"k.{key}").eqNullSafe(F.col(f"f.{key}")), "left_semi")
            again = again.select(F.col(key).alias("_again"))
            new = fresh.join(again, F.col(key).eqNullSafe(F.col("_again")), "left_anti")
            write_batch(new.repartition(BUCKET), store, run, number, BUCKET)
        finally:
            fresh.unpersist()

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def compact_first_seen(spark: SparkSession, store: str, target: str) -> DataFrame:
    """Write a store of many batches as one folder per bucket to ``target``, where the stream then goes on.

    A batch that runs again on the target finds its keys there and adds nothing, so no row is lost or doubled.
    The stream must stand still meanwhile.
    """
    rows = spark.read.parquet(store).drop(*MARKS)
    write_batch(rows.hint("rebalance", BUCKET), target, "compacted", -1, BUCKET)
    return spark.read.parquet(target)


def first_seen_stateful(stream: DataFrame, key: str, store: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """The same by the built-in operator: exact too, with one state entry per key ever seen."""
    return (
        stream.dropDuplicates([key]).writeStream.format("parquet").option("path", store)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )

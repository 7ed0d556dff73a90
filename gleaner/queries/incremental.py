"""Streams over the event days, as files that arrive a few per trigger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.queries import Tables, query
from gleaner.session import scratch_path
from gleaner.streaming.first_seen import compact_first_seen, first_seen, first_seen_stateful
from gleaner.streaming.latest import read_latest, upsert_latest


def _arrivals(t: Tables) -> DataFrame:
    """The events of each day as files of their own, read back as a stream."""
    root = scratch_path(t.spark, "arrivals")
    daily = t.events.withColumn("day", F.to_date("ts"))
    daily.write.partitionBy("day").parquet(root)
    return t.spark.readStream.schema(daily.schema).option("maxFilesPerTrigger", 10).parquet(root)


_KEYS = "SELECT user_id, 1::BIGINT AS n_rows FROM events GROUP BY 1"


@query("incremental_first_seen", _KEYS)
def _(t: Tables) -> DataFrame:
    store, checkpoint = scratch_path(t.spark, "seen"), scratch_path(t.spark, "checkpoint")
    first_seen(_arrivals(t), "user_id", ["ts", "event_id"], store, checkpoint).awaitTermination()
    return t.spark.read.parquet(store).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "incremental_first_seen_compacted",
    """SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE), ts, event_id) = 1""",
)
def _(t: Tables) -> DataFrame:
    """The first days, then the store compacted, then the rest into the compacted store under the same checkpoint."""
    days = t.events.withColumn("day", F.to_date("ts"))
    half = days.agg(F.expr("percentile_approx(day, 0.5)").alias("day")).scalar()
    root, checkpoint = scratch_path(t.spark, "arrivals"), scratch_path(t.spark, "checkpoint")
    store, target = scratch_path(t.spark, "seen"), scratch_path(t.spark, "compacted")
    stream = lambda: t.spark.readStream.schema(days.schema).parquet(root)
    days.filter(F.col("day") <= half).write.partitionBy("day").parquet(root)
    first_seen(stream(), "user_id", ["ts", "event_id"], store, checkpoint).awaitTermination()
    compact_first_seen(t.spark, store, target)
    days.filter(F.col("day") > half).write.mode("append").partitionBy("day").parquet(root)
    first_seen(stream(), "user_id", ["ts", "event_id"], target, checkpoint).awaitTermination()
    return t.spark.read.parquet(target).select("user_id", "event_id")


@query("incremental_first_seen_stateful", _KEYS)
def _(t: Tables) -> DataFrame:
    store, checkpoint = scratch_path(t.spark, "seen"), scratch_path(t.spark, "checkpoint")
    first_seen_stateful(_arrivals(t), "user_id", store, checkpoint).awaitTermination()
    return t.spark.read.parquet(store).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "incremental_upsert_latest",
    """SELECT user_id, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def _(t: Tables) -> DataFrame:
    store, checkpoint = scratch_path(t.spark, "latest"), scratch_path(t.spark, "checkpoint")
    upsert_latest(_arrivals(t), "user_id", ["ts", "event_id"], store, checkpoint).awaitTermination()
    return read_latest(t.spark, store, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")

"""A bounded sample of labelled rows for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, doc_id: str = "doc_id") -> DataFrame:
    """At most ``rows`` labelled documents, those whose id hashes lowest, with ``target`` 0 or 1.

    The bound makes the broadcast safe. A document with several labels takes the largest; null labels
    and ids do not count.
    """
    docs = docs.drop("_id", "target")  # names given here
    known = labels.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{label}`").cast("double").alias("target"))
    known = known.dropna().groupBy("_id").agg(F.max("target").alias("target"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    return docs.join(F.broadcast(chosen), F.col(f"`{doc_id}`") == F.col("_id")).drop("_id")

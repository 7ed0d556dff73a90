"""Connected components of a link table that may be as large as the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import written


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """(node, component) of every node of ``links(a, b)``; the component is its least node.

    Alternates two steps until nothing changes: every node sends its larger neighbours to its least one, then
    every node sends itself and its smaller neighbours to the least. Each step writes its links, so lineage
    stays short; only one row with a count and a sum reaches the driver. A node's least neighbour is a partial
    aggregate, so a node with very many links is no burden to one task.
    """
    edges = written(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label
    )
    nodes = edges.select("u").union(edges.select("v")).distinct().withColumnRenamed("u", "node")
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u <> v").distinct(), label)
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(low, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("c", "m")).filter("u <> v")
        edges = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    found = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return found.union(roots).join(nodes, "node", "left_semi")

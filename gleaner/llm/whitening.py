"""Whitening of embeddings with equal vectors fitted and projected once.

1. Rows whose vector is null or holds null or non-finite entries are dropped. Every entry c becomes the long
   ``floor(SCALE * c) + SHIFT``; beyond plus or minus 2**52 it is held there, as doubles are no finer.
2. Equal integer vectors are one group with its number of rows. The fit counts every group that many times
   (``weight="count"``) or once (``weight="one"``).
3. Sums per dimension are exact whole numbers. The covariance is a weighted product of matrices: every task
   centres its vectors, multiplies, and gives one row per cell; Spark adds the cells up. Only one number per pair
   of dimensions reaches the driver, whatever the number of rows.
4. The driver takes the eigenvectors. Each group is projected once, and its rows get the result by a join on a
   SHA-256 of the integer vector. A vector that a third of the rows share is one group to the fit; in the join it is a
   skewed key of one side only, which Spark splits.

Vectors of another length than the most common one (of two as common, the larger) are dropped, empty ones too; a table
without any other row gives no rows. A null id is carried, repeated rows are rows of their own, other columns are not
looked at, whatever their names. A component without variance (all rows equal, or fewer rows than dimensions) has a
null ``whitened`` and is left out of ``identity_error``; ``explained`` is null if no dimension varies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, written
from gleaner.llm.vectors import common_length, finite, held, matrix, vector_key

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
LIMIT = float(1 << 52)
_SAFE = 1 << 62

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"


def integer_vectors(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, x) of the rows that count."""
    entries = F.transform(F.col(f"`{vector}`"), lambda c: F.floor(held(c.cast("double") * SCALE, LIMIT)).cast("long") + SHIFT)
    return rows.filter(finite(F.col(f"`{vector}`"))).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), entries.alias("x"))


def _weighted_sums(x: np.ndarray, weight: np.ndarray) -> list[int]:
    """Exact sums of weight * x per dimension."""
    if int(weight.max()) * int(np.abs(x).max()) * len(x) < _SAFE:
        return [int(s) for s in weight @ x]
    return list(weight.astype(object) @ x.astype(object))


def exact_sums(groups: DataFrame, d: int) -> tuple[int, list[int]]:
    """The weights' sum and the weighted sum of every dimension, as whole numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [0] * (d + 1)
        for batch in batches:
            if batch.num_rows:
                x, weight = matrix(batch.column(0), np.int64), batch.column(1).to_numpy()
                for i, s in enumerate([int(weight.sum()), *_weighted_sums(x, weight)]):
                    totals[i] += s
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array([str(t) for t in totals])], names=["i", "total"])

    parts = groups.select("x", "weight").mapInArrow(run, "i int, total string")
    found = {r["i"]: int(r["total"]) for r in parts.groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    return found[0], [found[i + 1] for i in range(d)]


class Centre:
    """The mean S / n as a whole number and a rest in [0, 1), so that centring loses nothing to the shift."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.base = np.array([s // n for s in sums], np.int64)
        self.over = [s % n for s in sums]
        self.rest = np.array([r / n for r in self.over])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.rest

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S) ** 2 for every row, exact: n * x - S is n * y - r with y = x - base."""
        y, over = x - self.base, np.array(self.over, object)
        top = int(np.abs(y).max(initial=0))
        if top * top * y.shape[1] < _SAFE and top * self.n * y.shape[1] < _SAFE:
            over = over.astype(np.int64)
        else:
            y = y.astype(object)
        rest = sum(r * r for r in self.over)
        return [self.n * self.n * int(a) - 2 * self.n * int(b) + rest for a, b in zip((y * y).sum(axis=1), y @ over)]


def covariance(groups: DataFrame, centre: Centre) -> np.ndarray:
    """Weighted covariance of the groups, centred before multiplying, divisor n."""
    d = len(centre.base)
    low, high = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                y = centre.centred(matrix(batch.column(0), np.int64))
                product += (y * batch.column(1).to_numpy()[:, None]).T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(len(low)), pa.int32()), pa.array(product[low, high])], names=["cell", "value"])

    cells = groups.select("x", "weight").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    upper = np.zeros(len(low))
    for r in cells.collect():
        upper[r["cell"]] = r["value"]
    full = np.zeros((d, d))
    full[low, high] = upper / centre.n
    full[high, low] = full[low, high]
    return full


def axes(cov: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit eigenvectors in columns, their eigenvalues in falling order, and the trace; each vector's largest entry is positive."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return vectors * np.where(largest < 0, -1.0, 1.0), values, float(np.trace(cov))


def project(groups: DataFrame, centre: Centre, vectors: np.ndarray, values: np.ndarray) -> DataFrame:
    """(key, weight, digits, z): exact deviation and whitened components of every group."""
    with np.errstate(divide="ignore", invalid="ignore"):
        scaled = vectors / np.sqrt(np.maximum(values, 0))
    flat = ~np.isfinite(scaled).all(axis=0)
    scaled = np.where(flat, 0.0, scaled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(2), np.int64)
            z = centre.centred(x) @ scaled
            entries = pa.array(z.ravel(), mask=np.broadcast_to(flat, z.shape).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), entries)
            digits = pa.array([str(v) for v in centre.deviations(x)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digits, lists], names=["key", "weight", "digits", "z"])

    return groups.select("key", "weight", "x").mapInArrow(run, "key binary, weight long, digits string, z array<double>")


def identity_error(whitened: DataFrame, n: int, kept: list[int]) -> float | None:
    """Largest absolute entry of the whitened covariance, centred, minus the identity."""
    if not kept:
        return None
    z = {i: F.col("z")[i] for i in kept}
    means = whitened.agg(*[(F.sum(F.col("weight") * z[i]) / n).alias(f"m{i}") for i in kept]).first()
    pairs = [(i, j) for i in kept for j in kept if i <= j]
    cells = [F.sum(F.col("weight") * (z[i] - means[f"m{i}"]) * (z[j] - means[f"m{j}"])) / n for i, j in pairs]
    row = whitened.agg(*[c.alias(f"c{at}") for at, c in enumerate(cells)]).first()
    return max(abs(row[at] - (i == j)) for at, (i, j) in enumerate(pairs))


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, weight: str = "count") -> DataFrame:
    """One row per remaining row and component, as the module says; ``weight`` is "count" or "one"."""
    if weight not in ("count", "one"):
        raise ValueError('weight is "count" or "one"')
    spark = rows.sparkSession
    bounded_batches(spark)
    ids = integer_vectors(rows, vec_id, vector)
    times = F.count(F.lit(1)) if weight == "count" else F.lit(1).cast("long")
    groups = written(ids.groupBy("x").agg(times.alias("weight"), F.count(F.lit(1)).alias("rows")).withColumn("key", vector_key(F.col("x"))), "whitening-groups")
    d, _ = common_length(groups, "x", "rows")
    if not d:
        return spark.createDataFrame([], RESULT)
    groups = groups.filter(F.size("x") == d)
    n, sums = exact_sums(groups, d)
    centre = Centre(n, sums)
    vectors, values, trace = axes(covariance(groups, centre), min(components, d))
    values = np.where(values > d * np.finfo(float).eps * max(trace, 0.0), values, 0.0)
    table = written(project(groups, centre, vectors, values), "whitening-projected")
    error = identity_error(table, n, [int(i) for i in np.flatnonzero(values)])
    shares = F.array(*[F.lit(float(v / trace)) if trace > 0 else F.lit(None).cast("double") for v in values])
    found = ids.select("vec_id", vector_key(F.col("x")).alias("key")).join(table.drop("weight"), "key")
    return found.select("vec_id", "digits", F.posexplode("z").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), F.expr("try_cast(digits AS BIGINT)").alias("deviation"),
        "whitened", shares[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"), F.col("digits").alias("deviation_digits"),
    )

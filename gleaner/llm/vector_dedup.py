"""Near-duplicate embeddings: sign hashes of random hyperplanes in several tables, exact cosines, components.

1. Vectors that are null, zero or hold null or non-finite entries link with nothing. Equal vectors are one class with
   its number of rows, so copies are never compared with each other.
2. Every class gets one sign bit per random hyperplane. ``bits`` of them are the code of one table; a class stands once
   in every table. ``bits`` grows with the logarithm of the number of classes, and ``tables`` is derived from it:
   two vectors at exactly the least cosine share a code in some table with probability ``RECALL`` (closer ones more often).
3. Only the bits travel to the buckets of equal codes. A bucket of more than ``PART`` classes is dealt into parts, and
   each pair of parts is a unit of its own, so no task holds more than two parts and no pair of a bucket is left out. In
   a unit, classes come out that agree with another one on enough of ``SKETCH`` bits (5 deviations below the
   mean at the least cosine) and share no code with it in an earlier table.
4. Only those travel again, with their vectors, and every pair of a unit is decided by its cosine in double precision.
   A pair counts in the first table in which its codes are equal, so once. Out come, per class, the
   number of rows linked with it and its least partner group: one row per class and unit, never one per pair.
5. Links are joined into components; a component is named by its least vec_id.

Vectors of different lengths never link; scaling a vector changes no link. A row with a null id links with nothing and keeps
a null component; rows that repeat an id are vectors of their own. Every row comes out once; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, small_side, written
from gleaner.llm.graph import components
from gleaner.llm.vectors import finite, matrix, vector_key, whole

COSINE = 0.9
RECALL = 0.9999
SKETCH = 256
BUCKET = 512
PART = 2048
_ROWS = 256
_SEED = 271828


def table_shape(classes: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Bits per code and number of tables: buckets of about ``BUCKET`` unrelated classes, and the wanted recall."""
    bits = max(4, math.ceil(math.log2(max(classes, 1) / BUCKET)))
    hit = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log1p(-hit))


def most_apart(cosine: float) -> int:
    """Bits of ``SKETCH`` that may differ: 5 deviations above the mean of a pair at ``cosine``."""
    p = math.acos(cosine) / math.pi
    return math.ceil(SKETCH * p + 5 * math.sqrt(SKETCH * p * (1 - p)))


@cache
def _planes(d: int, count: int) -> np.ndarray:
    return np.random.default_rng((_SEED, d)).standard_normal((count, d)).T


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by a power of two first, so that squares neither overflow nor vanish."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    vectors = np.ldexp(vectors, -exponent[:, None])
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def codes_of(packed: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The code of every table from packed sign bits, one row per vector."""
    flags = np.unpackbits(packed, axis=1, count=bits * tables).reshape(len(packed), tables, bits)
    return flags @ (1 << np.arange(bits, dtype=np.int64))


def sketches(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(node, dims, signs, codes) of every class."""
    count = max(SKETCH, bits * tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy()
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                part = batch.take(pa.array(at))
                signs = np.packbits(unit_vectors(matrix(part.column(1), np.float64)) @ _planes(int(d), count) > 0, axis=1)
                codes = codes_of(signs, bits, tables)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * tables, pa.int32()), pa.array(codes.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(lengths[at], pa.int32()), pa.array([r.tobytes() for r in signs], pa.binary()), lists],
                    names=["node", "dims", "signs", "codes"],
                )

    return classes.select("node", "v").mapInArrow(run, "node long, dims int, signs binary, codes array<long>")


_UNIT = ["dims", "tab", "code", "low", "high"]


def units(sketched: DataFrame) -> DataFrame:
    """Every class in every unit in which it is compared: (dims, tab, code, low, high, part, node, signs)."""
    rows = sketched.select("node", "dims", "signs", F.posexplode("codes").alias("tab", "code"))
    sizes = rows.groupBy("dims", "tab", "code").count().filter(F.col("count") > PART)
    dense = small_side(sizes.select("dims", "tab", "code", F.ceil(F.col("count") / PART).cast("int").alias("parts")), "vectors-dense")
    rows = rows.join(dense, ["dims", "tab", "code"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select("dims", "tab", "code", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "signs")


def _sides(part: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the unit's two parts; within one part both are all rows."""
    return np.flatnonzero(part == low), np.flatnonzero(part == high)


def _seen(codes: np.ndarray, tab: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs that share a code in a table before ``tab``."""
    seen = np.zeros(len(i), bool)
    for t in range(tab):
        seen |= codes[i, t] == codes[j, t]
    return seen


def _signs(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(whole(table, "signs").to_pylist()), np.uint8).reshape(table.num_rows, -1)


def members(rows: DataFrame, bits: int, tables: int, cosine: float) -> DataFrame:
    """The classes of every unit that may link there, by their sign bits."""
    apart = most_apart(cosine)

    def run(key, table):
        dims, tab, code, low, high = (k.as_py() for k in key)
        part, signs = whole(table, "part").to_numpy(), _signs(table)
        words = np.ascontiguousarray(signs[:, : SKETCH // 8]).view(np.uint64)
        codes = codes_of(signs, bits, tables)
        left, right = _sides(part, low, high)
        keep = np.zeros(len(part), bool)
        for at in range(0, len(left), _ROWS):
            mine = left[at : at + _ROWS]
            differ = np.zeros((len(mine), len(right)), np.uint16)
            for w in range(words.shape[1]):
                differ += np.bitwise_count(words[mine, w][:, None] ^ words[right, w][None, :])
            i, j = np.nonzero(differ <= apart)
            i, j = mine[i], right[j]
            fresh = i != j if low != high else i < j
            i, j = i[fresh], j[fresh]
            new = ~_seen(codes, tab, i, j)
            keep[i[new]] = keep[j[new]] = True
        node = whole(table, "node").to_numpy()[keep]
        size = len(node)
        return pa.table({
            "dims": pa.array(np.full(size, dims, np.int32)), "tab": pa.array(np.full(size, tab, np.int32)), "code": pa.array(np.full(size, code, np.int64)),
            "low": pa.array(np.full(size, low, np.int32)), "high": pa.array(np.full(size, high, np.int32)),
            "part": pa.array(part[keep], pa.int32()), "node": pa.array(node),
        })

    return rows.groupBy(*_UNIT).applyInArrow(run, "dims int, tab int, code long, low int, high int, part int, node long")


def verified(rows: DataFrame, bits: int, tables: int, cosine: float) -> DataFrame:
    """(node, links, root): rows linked with a class in one unit, and the least class it hangs together with there."""

    def run(key, table):
        _, tab, _, low, high = (k.as_py() for k in key)
        part, node = whole(table, "part").to_numpy(), whole(table, "node").to_numpy()
        weight, codes = whole(table, "weight").to_numpy(), codes_of(_signs(table), bits, tables)
        vectors = unit_vectors(matrix(whole(table, "v"), np.float64))
        left, right = _sides(part, low, high)
        links, group = np.zeros(len(node), np.int64), np.arange(len(node))
        for at in range(0, len(left), _ROWS):
            mine = left[at : at + _ROWS]
            i, j = np.nonzero(vectors[mine] @ vectors[right].T >= cosine)
            i, j = mine[i], right[j]
            fresh = i != j if low != high else i < j
            i, j = i[fresh], j[fresh]
            new = ~_seen(codes, tab, i, j)
            i, j = i[new], j[new]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            first = np.flatnonzero(np.diff(i, prepend=-1))
            for a, others in zip(i[first], np.split(j, first[1:])):
                joined = np.unique(group[np.append(others, a)])
                if len(joined) > 1:
                    group[np.isin(group, joined)] = joined[0]
        hit = np.flatnonzero(links)
        least = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(least, group, node)
        return pa.table({"node": pa.array(node[hit]), "links": pa.array(links[hit]), "root": pa.array(least[group[hit]])})

    return rows.groupBy(*_UNIT).applyInArrow(run, "node long, links long, root long")


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row, as the module says."""
    bounded_batches(rows.sparkSession)
    ids, vectors = F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`")
    counts = ids.isNotNull() & finite(vectors) & F.coalesce(F.exists(vectors, lambda c: c != 0), F.lit(False))
    zero = F.lit(0).cast(rows.schema[vector].dataType.elementType)  # added, it makes the two zeros of floating point one value
    rows = rows.select(ids, F.when(counts, F.transform(vectors, lambda c: c + zero)).alias("v"))
    classes = rows.filter("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    classes = written(classes.select("v", "weight", "least", vector_key(F.col("v")).alias("key"), F.monotonically_increasing_id().alias("node")), "vectors-classes")
    bits, tables = table_shape(classes.count(), cosine, recall)
    sketched = written(sketches(classes, bits, tables), "vectors-signs")
    found = written(members(units(sketched), bits, tables, cosine), "vectors-members")
    full = found.join(classes.select("node", "v", "weight"), "node").join(sketched.select("node", "signs"), "node")
    links = written(verified(full, bits, tables, cosine), "vectors-links")
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")), "vectors-components")
    nodes = classes.select("node", "key", "weight", "least").join(counted, "node", "left").join(joined, "node", "left")
    nodes = nodes.withColumn("component", F.coalesce("component", "node"))
    names = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(names, "component").select("key", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", vector_key(F.col("v")).alias("key")).join(nodes, "key", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )


def oracle() -> str:
    """All pairs and the closure of their links in SQL."""
    return f"""
        WITH RECURSIVE u AS (
            SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), pairs AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_cosine_similarity(a.v, b.v) >= {COSINE}
        ), reach(a, b) AS (
            SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
        )
        SELECT e.vec_id, coalesce(n.links, 0) AS n_links, least(e.vec_id, coalesce(r.least, e.vec_id)) AS component_id,
            e.vec_id <= coalesce(r.least, e.vec_id) AS kept
        FROM embeddings e
        LEFT JOIN (SELECT a, count(*) AS links FROM pairs GROUP BY a) n ON n.a = e.vec_id
        LEFT JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) r ON r.a = e.vec_id"""

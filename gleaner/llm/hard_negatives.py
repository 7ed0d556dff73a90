"""Hard negatives for contrastive training, scored exactly by products of matrices in residue numbers.

1. Rows with a null id, label or vector, or any null or non-finite component, take no part; nor do vectors of another length
   than the most common one (of two as common, the larger). Components become ``floor(SCALE * x)``, held
   within plus or minus 2**23, so that scores fit a long.
2. Anchors (``vec_id`` divisible by ``every``) and all rows are dealt into blocks of bounded size, whatever their labels, and
   every block of anchors meets every block of rows in a task of its own. This is a stated query set against all rows.
3. A task multiplies the two blocks modulo several small primes, in single precision: residues are at most 125
   away from zero, so sums over up to 1073 dimensions stay below 2**24 and are exact; longer vectors are summed in stretches.
   As many primes are used as the largest possible score asks for. The signed score comes back by the Chinese remainder theorem, digit by digit.
4. First pass: every task gives an anchor's best rows of its own label, and a window over all tasks keeps the first
   ``positives``. Second pass: every task gives the best rows of other labels within the bounds of each positive, and a window
   keeps the first ``negatives`` of each. Higher scores come first, ties by smaller id.

Rows that repeat an id are rows of their own: a repeated anchor gives its rows once per repetition, and a row is no partner of an
anchor with its id. Other columns are not looked at. Empty tables, and tables without anchors, give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, written
from gleaner.llm.vectors import common_length, finite, held, matrix, whole

SCALE = 256
LIMIT = float(1 << 23)
PRIMES = (251, 241, 239, 233, 229, 227, 223, 211, 199)
BLOCK = 65_536
LEAST_BLOCK = 1024
BLOCKS = 48
_CELLS = 1 << 19

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def primes_for(d: int, largest: int) -> tuple[int, ...]:
    """The first primes whose product tells all scores of ``d`` components up to ``largest`` apart, signs included."""
    product, used = 1, 0
    while product <= 2 * d * largest * largest + 1:
        product *= PRIMES[used]
        used += 1
    return PRIMES[:used]


def _residues(values: np.ndarray, p: int) -> np.ndarray:
    """Remainders of least absolute value, in single precision."""
    half = p // 2
    return ((values + half) % p - half).astype(np.float32)


def exact_products(a: np.ndarray, b: np.ndarray, primes: tuple[int, ...]) -> np.ndarray:
    """``a @ b.T`` of whole numbers, from single-precision products modulo each prime."""
    out = np.zeros((len(a), len(b)), np.int64)
    radix = 1
    for p in primes:
        step = (1 << 24) // (p // 2) ** 2
        left, right = _residues(a, p), _residues(b, p)
        rest = np.zeros(out.shape, np.int32)
        for at in range(0, a.shape[1], step):
            rest += (left[:, at : at + step] @ right[:, at : at + step].T).astype(np.int32) % p
        # the next digit in mixed radix, between -p // 2 and p // 2, so the sum is signed
        digit = (rest - out % p).astype(np.int64) * pow(radix, -1, p) % p
        digit[digit > p // 2] -= p
        out += digit * radix
        radix *= p
    return out


def integer_rows(rows: DataFrame, vec_id: str, label: Column, vector: str) -> DataFrame:
    """(id, label, v) of the rows that take part, whatever their length."""
    col = F.col(f"`{vector}`")
    entries = F.transform(col, lambda c: F.floor(held(c.cast("double") * SCALE, LIMIT)).cast("int"))
    kept = rows.filter(finite(col) & F.col(f"`{vec_id}`").isNotNull() & label.isNotNull())
    return kept.select(F.col(f"`{vec_id}`").cast("long").alias("id"), label.cast("long").alias("label"), entries.alias("v"))


def _blocks(table: DataFrame, n: int, own: str, other: str, others: int) -> DataFrame:
    """Rows with the number of their block and, once each, of every block they meet."""
    numbered = table.withColumn(own, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int"))
    return numbered.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


class Mine:
    """Blocks of anchors against blocks of rows."""

    def __init__(self, rows: DataFrame, n_rows: int, n_anchors: int, primes: tuple[int, ...]):
        self.primes = primes
        per_block = min(BLOCK, max(LEAST_BLOCK, -(-n_rows // BLOCKS)))
        self.row_blocks, self.anchor_blocks = -(-n_rows // per_block), -(-n_anchors // BLOCK)
        self.rows = _blocks(rows, self.row_blocks, "rb", "ab", self.anchor_blocks)

    def each(self, anchors: DataFrame, fn: Callable, schema: str) -> DataFrame:
        """``fn(anchors, rows, primes)`` of every pair of blocks; both are Arrow tables, the rows in order of their ids."""
        primes = self.primes

        def run(left, right):
            return fn(left, right.sort_by("id"), primes)

        dealt = _blocks(anchors, self.anchor_blocks, "ab", "rb", self.row_blocks)
        return dealt.groupBy("ab", "rb").cogroup(self.rows.groupBy("ab", "rb")).applyInArrow(run, schema)


def _stretches(a: int, r: int) -> Iterator[slice]:
    step = max(1, _CELLS // max(r, 1))
    for at in range(0, a, step):
        yield slice(at, at + step)


_BEST = "key long, anchor_id long, id long, score long"


def best_of_label(count: int) -> Callable:
    """The first ``count`` other rows of its label for every anchor of a block."""
    def run(left: pa.Table, right: pa.Table, primes: tuple[int, ...]) -> pa.Table:
        out = [[] for _ in range(4)]
        if left.num_rows and right.num_rows:
            key, anchor, mine = (whole(left, c).to_numpy() for c in ("key", "id", "label"))
            ids, theirs = whole(right, "id").to_numpy(), whole(right, "label").to_numpy()
            a, b = matrix(whole(left, "v"), np.int64), matrix(whole(right, "v"), np.int64)
            for value in np.unique(mine):
                rows, own = np.flatnonzero(theirs == value), np.flatnonzero(mine == value)
                if not len(rows):
                    continue
                for part in _stretches(len(own), len(rows)):
                    scores = exact_products(a[own[part]], b[rows], primes)
                    for at, s in zip(own[part], scores):
                        fit = np.flatnonzero(ids[rows] != anchor[at])
                        first = _first(s[fit], count)
                        for column, values in zip(out, (np.full(len(first), key[at]), np.full(len(first), anchor[at]), ids[rows][fit][first], s[fit][first])):
                            column.append(values)
        return _table(out, ("key", "anchor_id", "id", "score"))

    return run


def _first(scores: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` highest scores in falling order, earlier places first among equals."""
    if len(scores) > 4 * count:
        least = np.partition(scores, len(scores) - count)[len(scores) - count]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.argsort(-scores[at], kind="stable")][:count]


def _table(columns: list[list[np.ndarray]], names: tuple[str, ...]) -> pa.Table:
    return pa.table({n: pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for n, c in zip(names, columns)})


_WITHIN = "key long, id long, score long"


def best_within(count: int) -> Callable:
    """Rows of other labels that are among the first ``count`` within the bounds of one of an anchor's positives."""
    def run(left: pa.Table, right: pa.Table, primes: tuple[int, ...]) -> pa.Table:
        out = [[] for _ in range(3)]
        if left.num_rows and right.num_rows:
            key, mine, bounds = whole(left, "key").to_numpy(), whole(left, "label").to_numpy(), whole(left, "positives").to_pylist()
            ids, theirs = whole(right, "id").to_numpy(), whole(right, "label").to_numpy()
            a, b = matrix(whole(left, "v"), np.int64), matrix(whole(right, "v"), np.int64)
            for part in _stretches(len(a), len(b)):
                for at, s in zip(range(part.start, part.stop), exact_products(a[part], b, primes)):
                    chosen = []
                    for positive in bounds[at]:
                        least, most = window_of(positive)
                        fit = np.flatnonzero((s >= least) & (s <= most) & (theirs != mine[at]))
                        chosen.append(fit[_first(s[fit], count)])
                    found = np.unique(np.concatenate(chosen))
                    for column, values in zip(out, (np.full(len(found), key[at]), ids[found], s[found])):
                        column.append(values)
        return _table(out, ("key", "id", "score"))

    return run


LOW, HIGH = 30, 90


def window_of(positive: int) -> tuple[int, int]:
    """Least and most negative score with LOW % and HIGH % of a positive score around it."""
    return -(-LOW * positive // 100), HIGH * positive // 100


def hard_negatives(
    rows: DataFrame, vec_id: str = "vec_id", label: Column | str = "label", vector: str = "embedding", every: int = 100, positives: int = 5, negatives: int = 10
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, as the module says."""
    spark = rows.sparkSession
    bounded_batches(spark)
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    table = written(integer_rows(rows, vec_id, label, vector), "negatives-rows")
    d, n_rows = common_length(table, "v")
    table = table.filter(F.size("v") == d)
    anchors = written(table.filter(F.col("id") % every == 0).withColumn("key", F.monotonically_increasing_id()), "negatives-anchors")
    n_anchors = anchors.count()
    if not n_anchors:
        return spark.createDataFrame([], RESULT)
    largest = table.agg(F.max(F.array_max(F.transform("v", lambda c: F.abs(c))))).first()[0]
    mine = Mine(table, n_rows, n_anchors, primes_for(d, max(largest, 1)))

    best = mine.each(anchors, best_of_label(positives), _BEST)
    order = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    best = written(best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives), "negatives-positives")

    scores = best.groupBy("key").agg(F.collect_set("score").alias("positives"))
    within = mine.each(anchors.join(scores, "key"), best_within(negatives), _WITHIN)
    pairs = best.select("key", "place", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(
        within.select("key", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), "key"
    )
    least, most = F.col("positive_score") * LOW, F.col("positive_score") * HIGH
    pairs = pairs.filter((least <= F.col("negative_score") * 100) & (F.col("negative_score") * 100 <= most))
    order = Window.partitionBy("key", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def oracle() -> str:
    """The same rows in SQL, with whole-number products of all anchors and rows."""
    return f"""
        WITH e AS (
            SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: greatest(least(floor({SCALE} * x::DOUBLE), {int(LIMIT)}), {-int(LIMIT)})) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.id AS anchor_id, r.id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
            FROM e a JOIN e r ON a.id <> r.id WHERE a.id % 100 = 0
        ), p AS (
            SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
        ), n AS (
            SELECT p.*, s.id AS negative_id, s.score AS negative_score,
                row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank
            FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
                AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score
        )
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""

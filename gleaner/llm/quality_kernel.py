"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of the whole text (lengths, shares of character classes, repetition, lines) are standardised, mapped
by ``FEATURES`` random cosines that approximate a Gaussian kernel, and fitted to the labels by ridge regression.
Every partition sums its part of the normal equations; only the summed entries, whose number depends on
``FEATURES`` alone, reach the driver. Raw scores are calibrated by isotonic regression on a fifth of the sample that
the fit does not see. Labels, language, source and id are never inputs.

At most ``SAMPLE`` labelled rows are used, none of them held out (crc32 of the id as text, modulo 5, is 0). Null and
empty texts have statistics like any other and get a score. Without usable labels the score is the
``PRIOR``; with one kind of label it is that label. Repeated rows come out once each; a null id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import SPACED, byte_table, map_batches, mixed, repeated_words, run_hashes, word_bounds, word_hashes, written
from gleaner.llm.labelled import labelled_sample

SAMPLE = 20_000
FEATURES = 256
WIDTH = 5.0
RIDGE = 1e-3
THRESHOLD = 0.3
PRIOR = 0.5

_CLASSES = np.stack([
    byte_table(lambda b: 0x41 <= b <= 0x5A),
    byte_table(lambda b: 0x61 <= b <= 0x7A),
    byte_table(lambda b: 0x30 <= b <= 0x39),
    byte_table(lambda b: b >= 0xC0),
    byte_table(lambda b: b == 0x20),
    byte_table(lambda b: chr(b) in ".,;:'\"()-"),
    byte_table(lambda b: chr(b) in "!?"),
    byte_table(lambda b: chr(b) in "#*$%&@^~+="),
    byte_table(lambda b: chr(b) in "|<>{}[]\\/_"),
    byte_table(lambda b: b < 0x20),
]).astype(np.float64)
STATISTICS = 28


def statistics(text: bytes) -> np.ndarray:
    """``STATISTICS`` numbers of bounded size: logarithms of counts, and shares between 0 and 1."""
    data = np.frombuffer(text, np.uint8)
    words = word_hashes(text, SPACED)
    n, m = max(1, len(data)), max(1, len(words))
    lead = max(1, int(((data & 0xC0) != 0x80).sum()))
    histogram = np.bincount(data, minlength=256)
    shares = _CLASSES @ histogram / lead
    p = histogram[histogram > 0] / n
    starts, ends = word_bounds(data, SPACED)
    sizes = ends - starts
    first = data[starts] if len(starts) else data[:0]
    last = data[ends - 1] if len(ends) else data[:0]
    lines = [x for x in text.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    distinct, times = np.unique(words, return_counts=True)
    pairs = run_hashes(words, 2)
    return np.array([
        np.log1p(len(data)), np.log1p(len(words)), np.log1p(len(lines)), np.log1p(len(data) / k),
        *shares,
        -(p * np.log(p)).sum() / np.log(256),
        sizes.mean() / 20 if len(sizes) else 0.0, min(5.0, sizes.std() / 10) if len(sizes) else 0.0, np.log1p(sizes.max()) if len(sizes) else 0.0,
        len(distinct) / m, times.max() / m if len(times) else 0.0,
        len(np.unique(pairs)) / max(1, len(pairs)),
        repeated_words(words, 3) / m, repeated_words(words, 5) / m,
        1 - len(set(lines)) / k,
        sum(x.rstrip()[-1:] in b".!?\"'" for x in lines) / k,
        np.isin(first, np.arange(0x41, 0x5B)).sum() / m,
        np.isin(last, np.frombuffer(b".,;:", np.uint8)).sum() / m,
        (words[1:] == words[:-1]).sum() / m,
    ])


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray | None
    steps: np.ndarray
    levels: np.ndarray

    def cosines(self, x: np.ndarray) -> np.ndarray:
        random = np.random.default_rng(11)
        directions = random.normal(0, 1 / WIDTH, (STATISTICS, FEATURES))
        phases = random.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.centre) / self.spread, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ directions + phases), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.weights if self.weights is not None else np.zeros(len(x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.steps, self.levels), 0, 1)


def isotonic(score: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the nondecreasing levels nearest to the targets, as points to interpolate."""
    xs, at = np.unique(score, return_inverse=True)
    weight = np.bincount(at).astype(float)
    mean = np.bincount(at, target) / weight
    pools: list[list[float]] = []  # mean, weight, first, last
    for x, w, m in zip(xs, weight, mean):
        pools.append([m, w, x, x])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m2, w2, _, end = pools.pop()
            m1, w1, start, _ = pools.pop()
            pools.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, start, end])
    steps = np.array([v for p in pools for v in ((p[2], p[3]) if p[3] > p[2] else (p[2],))])
    levels = np.array([p[0] for p in pools for _ in range(2 if p[3] > p[2] else 1)])
    return steps, levels


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def with_statistics(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    field = T.StructType([T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def run(texts: list[bytes]) -> dict[str, pa.Array]:
        flat = np.concatenate([statistics(t) for t in texts]) if texts else np.zeros(0)
        offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * STATISTICS)
        return {"stats": pa.ListArray.from_arrays(offsets, pa.array(flat, pa.float64()))}

    return map_batches(docs, text, run, field, keep)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, STATISTICS)


def _normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    size = FEATURES + 1
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                z, y = model.cosines(_matrix(batch.column(0))), batch.column(1).to_numpy()
                gram += z.T @ z
                right += z.T @ y
        values = np.concatenate([gram[upper], right])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["k", "v"])

    sums = rows.select("stats", "target").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(len(upper[0]) + size)
    flat[sums["k"].to_numpy()] = sums["v"].to_numpy()
    gram = np.zeros((size, size))
    gram[upper] = flat[: len(upper[0])]
    return gram + np.triu(gram, 1).T, flat[len(upper[0]) :]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE) -> Model:
    learn = labels.filter(~held_out(F.col("doc_id")))
    sample = labelled_sample(docs.select("doc_id", "text"), learn, label, rows)
    table = written(with_statistics(sample, "text", ["doc_id", "target"]), "statistics")
    moments = [f(F.col("stats")[i]).alias(f"{name}{i}") for i in range(STATISTICS) for name, f in (("m", F.avg), ("s", F.stddev_pop))]
    first = table.agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("low"), F.max("target").alias("high"), *moments).first()
    if first["n"] == 0 or first["low"] == first["high"]:
        level = PRIOR if first["n"] == 0 else float(first["low"])
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS), None, np.zeros(1), np.array([level]))
    centre = np.array([first[f"m{i}"] for i in range(STATISTICS)])
    spread = np.array([first[f"s{i}"] for i in range(STATISTICS)])
    model = Model(centre, np.where(spread > 1e-9, spread, 1.0), None, np.zeros(1), np.zeros(1))
    apart = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5)) == 0
    gram, right = _normal_equations(table.filter(~apart), model)
    penalty = RIDGE * max(1.0, gram[-1, -1]) * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-9
    model = Model(model.centre, model.spread, np.linalg.solve(gram + penalty, right), model.steps, model.levels)
    kept = table.filter(apart).select("stats", "target").toArrow()
    if not kept.num_rows:
        return Model(model.centre, model.spread, model.weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    steps, levels = isotonic(model.raw(_matrix(kept["stats"].combine_chunks())), kept["target"].to_numpy())
    return Model(model.centre, model.spread, model.weights, steps, levels)


def score_quality(docs: DataFrame, model: Model, keep: list[str], name: str = "score") -> DataFrame:
    """``keep`` columns of ``docs`` with the score of the whole text as column ``name``."""
    field = T.StructType([T.StructField(name, T.DoubleType())])

    def run(texts: list[bytes]) -> dict[str, pa.Array]:
        values = model.score(np.stack([statistics(t) for t in texts])) if texts else []
        return {name: pa.array(values, pa.float64())}

    return map_batches(docs, "text", run, field, keep)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_quality(docs, train(docs, labels), ["doc_id"])
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )

"""Quality rules: counted rules, then a hashed n-gram logistic regression with calibrated probabilities.

Words are split at ASCII white space. A document fails the rules when it has fewer than ``LEAST_WORDS`` words, or
more than ``MOST_REPEATED`` percent of its words lie in 5-word runs found twice or more. What passes is scored by a
logistic regression on hashed words and byte 3-grams (square roots of relative frequencies, so length does
not count), fitted on at most ``SAMPLE`` labelled rows; a logistic curve fitted on a fifth of them, kept apart, turns
its score into a probability. A document is kept when the probability is ``KEEP`` or more.

Null and empty texts have no words and fail. Texts of any length are read whole. Repeated rows come out once each.
Without labels, or with labels of one kind only, the rules alone decide. Other columns are not used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import SPACED, byte_table, map_batches, mixed, repeated_words, word_hashes
from gleaner.llm.labelled import labelled_sample

SAMPLE = 4000
WORD_SLOTS = 2048
GRAM_SLOTS = 2048
RUN = 5
LEAST_WORDS = 10
MOST_REPEATED = 20
KEEP = 0.3
ROUNDS = 300
RIDGE = 1e-4

_SYMBOL = byte_table(lambda b: chr(b) in "#*$%&|<>")
_LEAD = byte_table(lambda b: b & 0xC0 != 0x80)


def counts(text: bytes, words: np.ndarray) -> tuple[int, int, int, int]:
    """Characters in words, symbols, repeated lines, words in repeated runs."""
    data = np.frombuffer(text, np.uint8)
    seen, repeated = set(), 0
    for line in text.split(b"\n"):
        if line.strip():
            repeated += line in seen
            seen.add(line)
    return int((_LEAD[data] & SPACED[data]).sum()), int(_SYMBOL[data].sum()), repeated, repeated_words(words, RUN)


def features(text: bytes, words: np.ndarray) -> np.ndarray:
    """Square roots of the relative frequencies of hashed words and byte 3-grams."""
    out = np.zeros(WORD_SLOTS + GRAM_SLOTS, np.float32)
    if len(words):
        out[:WORD_SLOTS] = np.bincount((words % np.uint64(WORD_SLOTS)).astype(np.int64), minlength=WORD_SLOTS) / len(words)
    data = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(data) > 2:
        grams = (data[:-2] * np.uint32(0x9E3779B1) ^ data[1:-1] * np.uint32(0x85EBCA77) ^ data[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(20)
        out[WORD_SLOTS:] = np.bincount(grams % GRAM_SLOTS, minlength=GRAM_SLOTS) / len(grams)
    return np.sqrt(out)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, x: np.ndarray) -> float:
        z = float(x @ self.weights) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -50, 50))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent with a step from the largest squared row length."""
    n, d = x.shape
    w, v, bias, vb = np.zeros(d), np.zeros(d), 0.0, 0.0
    step = 4.0 / (float((x.astype(np.float64) ** 2).sum(axis=1).max()) + 1 + ridge)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v.astype(x.dtype) + vb, -50, 50)))
        g = (p - y) / n
        nw, nb = v - step * (x.T @ g.astype(x.dtype) + ridge * v), vb - step * float(g.sum())
        k = t / (t + 3)
        v, vb = nw + k * (nw - w), nb + k * (nb - bias)
        w, bias = nw, nb
    return w, bias


def fit(x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> Model | None:
    """Weights from the rows that are not ``apart``, calibration from those that are; None for one kind of label."""
    if len(set(y[~apart])) < 2:
        return None
    w, bias = _logistic(x[~apart], y[~apart], RIDGE, ROUNDS)
    slope, offset = 1.0, 0.0
    if len(set(y[apart])) == 2:
        z = x[apart] @ w + bias
        # targets drawn in a little from 0 and 1, so separable rows do not make an endless slope
        up, down = (y[apart] == 1).sum(), (y[apart] == 0).sum()
        goal = np.where(y[apart] == 1, (up + 1) / (up + 2), 1 / (down + 2))
        (slope,), offset = _logistic(z[:, None], goal, 1e-6, 2000)
        if slope <= 0:
            slope, offset = 1.0, 0.0
    return Model(w, bias, float(slope), float(offset))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model | None:
    """The hashed features, never the texts, of at most ``rows`` documents come to the driver."""
    field = T.StructType([T.StructField("x", T.BinaryType())])

    def run(texts: list[bytes]) -> dict[str, pa.Array]:
        return {"x": pa.array([features(t, word_hashes(t, SPACED)).astype(np.float16).tobytes() for t in texts], pa.binary())}

    sample = labelled_sample(docs.select("doc_id", "text"), labels, "quality", rows)
    found = map_batches(sample, "text", run, field, keep=["doc_id", "target"]).toArrow()
    if not found.num_rows:
        return None
    order = np.argsort(found["doc_id"].to_numpy(), kind="stable")
    x = np.frombuffer(b"".join(found["x"].to_pylist()), np.float16).reshape(found.num_rows, -1).astype(np.float32)[order]
    ids = found["doc_id"].to_numpy()[order]
    apart = mixed(ids.astype(np.uint64)) % np.uint64(5) == 0
    return fit(x, found["target"].to_numpy()[order], apart)


def quality_rules(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """Per row of ``docs``: the counts, whether the rules fail it, its probability, and whether it is kept."""
    model = train(docs, labels, rows)
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fields = T.StructType([T.StructField(c, T.LongType()) for c in longs] + [T.StructField("probability", T.DoubleType())])

    def run(texts: list[bytes]) -> dict[str, pa.Array]:
        table, chances = [], []
        for t in texts:
            words = word_hashes(t, SPACED)
            table.append((len(words), *counts(t, words)))
            chances.append(model.probability(features(t, words)) if model else 1.0)
        columns = list(zip(*table)) or [()] * len(longs)
        made = {name: pa.array(values, pa.int64()) for name, values in zip(longs, columns)}
        return made | {"probability": pa.array(chances, pa.float64())}

    scored = map_batches(docs.select("doc_id", "text"), "text", run, fields, keep=["doc_id"])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return scored.select(
        "doc_id", *longs, failed.alias("base_failed"), (~failed & (F.col("probability") >= keep)).alias("kept"), "probability"
    )

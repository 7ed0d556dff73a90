"""Shared pieces: bounded Arrow batches, tables in the shared folder, vectorised word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.session import scratch_path

BATCH_ROWS = 4000
BATCH_BYTES = 16 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are cut by bytes as well as rows, so very long texts do not pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder of ``spark.checkpoint.dir``, read back: lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, label: str) -> DataFrame:
    """``df`` written, and marked for broadcast only if it has no more than ``BROADCAST_ROWS`` rows."""
    table = written(df, label)
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def ascii_lower(col: Column | str) -> Column:
    """A-Z in lower case, every other character as it is; null becomes the empty text."""
    return F.translate(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")), UPPER, LOWER)


def map_batches(
    df: DataFrame, text: str, fn: Callable[[list[bytes]], dict[str, pa.Array]], new: T.StructType, keep: list[str] | None = None
) -> DataFrame:
    """Rows of ``df`` with columns computed from the whole texts of ``text``, batch by batch.

    ``fn`` gets the UTF-8 texts (null: empty) and returns one array per field of ``new``. ``keep`` names
    the columns to carry (default: all). A column of ``df`` with the name of a new one is replaced.
    """
    bounded_batches(df.sparkSession)
    added = [f.name for f in new]
    kept = [c for c in (df.columns if keep is None else keep) if c not in added]
    source = "_text_in"
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("binary").alias(source))
    schema = T.StructType([df.schema[c] for c in kept] + list(new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is not None else b"" for t in batch.column(batch.num_columns - 1).to_pylist()]
            made = fn(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(kept))] + [made[n] for n in added], names=kept + added
            )

    return rows.mapInArrow(run, schema)


# --- words of a text as 64-bit hashes, by whole-array arithmetic -------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    global _powers
    if len(_powers[0]) < n:
        size = max(1 << 16, 1 << n.bit_length())
        with np.errstate(over="ignore"):
            steps = np.full(size, _BASE), np.full(size, _BASE_INVERSE)
            for s in steps:
                s[0] = 1
            _powers = np.multiply.accumulate(steps[0]), np.multiply.accumulate(steps[1])
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_table(is_word: Callable[[int], bool]) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], dtype=np.int8)


#: Words between ASCII white space.
SPACED = byte_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words of ASCII letters, digits and every character beyond ASCII.
LETTERS = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)


def word_bounds(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the words of a text."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = table[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(text: bytes, table: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word of ``text``; A-Z must be in lower case already where that is wanted."""
    data = np.frombuffer(text, np.uint8)
    starts, ends = word_bounds(data, table)
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts])


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """One hash per run of ``k`` words, in order; none for a text with fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(k))
    for j in range(k):
        out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n])
    return out


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``k`` words; a shorter text is one run, an empty one none."""
    return np.unique(run_hashes(words, min(k, len(words)))) if len(words) else words


def repeated_words(words: np.ndarray, k: int) -> int:
    """Words that lie in a run of ``k`` words found twice or more in the text, its first place included."""
    runs = run_hashes(words, k)
    if not len(runs):
        return 0
    _, place, count = np.unique(runs, return_inverse=True, return_counts=True)
    step = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(count[place] > 1)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + k, -1)
    return int((np.cumsum(step) > 0).sum())

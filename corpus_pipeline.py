"""From raw documents to token ids: quality, near-duplicates, benchmark items, secrets, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet below the shared folder of
``spark.checkpoint.dir`` and reads it again as the next stage's documents. All but the last return the columns of
``documents``. Null texts count as empty, rows without an id pass the joins by id, repeated rows are duplicates of
each other, an empty table stays empty, and further columns are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.bpe import encode_and_decode
from gleaner.llm.common import fresh_name, written
from gleaner.llm.decontaminate import decontaminate
from gleaner.llm.minhash import keep_one
from gleaner.llm.quality_kernel import THRESHOLD, score_quality, train
from gleaner.llm.queries import tokenizer_path
from gleaner.llm.secrets import redact

#: SQL cannot express hashed sketches, a fitted model or a tokenizer
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    name = fresh_name(docs, "quality_score")
    scored = score_quality(docs, train(docs, _table(spark, sf_dir, "labels")), docs.columns, name)
    return scored.filter(F.col(name) >= THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the least id: five-word runs, 80 % in common."""
    return keep_one(docs, k=5)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; ``n_chars`` follows the text."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding gives the text back."""
    coded = encode_and_decode(docs, "text", tokenizer_path(), keep=["doc_id"], compare=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_items),
    ("secret_scan", secrets),
    ("bpe", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

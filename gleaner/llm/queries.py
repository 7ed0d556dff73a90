"""The registered queries of this folder and the DuckDB SQL that checks them, where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Runner = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "documents")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from gleaner.llm.decontaminate import find_items

    return find_items(_documents(spark, folder), _table(spark, folder, "benchmark"))


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    from gleaner.llm.licenses import scan_licenses

    return scan_licenses(_documents(spark, folder))


def op3_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    from gleaner.llm.minhash import near_duplicates

    return near_duplicates(_documents(spark, folder), k=2)


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    from gleaner.llm.secrets import secret_digests

    return secret_digests(_documents(spark, folder))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from gleaner.llm.quality_rules import quality_rules

    return quality_rules(_documents(spark, folder), _table(spark, folder, "labels"))


def op6_html_text(spark: SparkSession, folder: str) -> DataFrame:
    from gleaner.llm.style_tree import page_texts

    return page_texts(_table(spark, folder, "pages"))


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    from gleaner.llm.quality_kernel import classify

    return classify(_documents(spark, folder), _table(spark, folder, "labels"))


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    from gleaner.llm.bpe import token_digests

    return token_digests(_documents(spark, folder), tokenizer_path())


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    from gleaner.llm.warc import page_records

    return page_records(_table(spark, folder, "pages"))


def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    from gleaner.llm.chat import chat_digests

    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit(r"\### Assistant: </turn> ok")
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text")
    )
    return chat_digests(rows.unionByName(more), tokenizer_path())


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    from gleaner.llm.whitening import whiten

    return whiten(_table(spark, folder, "embeddings"))


def op12_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    from gleaner.llm.vector_dedup import near_vectors

    return near_vectors(_table(spark, folder, "embeddings"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    from gleaner.llm.hard_negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, folder, "embeddings"), label=moved)


QUERIES: tuple[Runner, ...] = (
    op1_decontamination, op2_license_scan, op3_near_duplicates, op4_secret_scan, op5_quality_rules, op6_html_text,
    op7_quality_classifier, op8_bpe, op9_warc, op10_chat, op11_whitening,
    op12_near_vectors, op13_hard_negatives,
)


def queries() -> dict[str, Runner]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    from gleaner.llm import hard_negatives, licenses, secrets, vector_dedup

    return {
        "op2_license_scan": licenses.oracle(), "op4_secret_scan": secrets.oracle(), "op12_near_vectors": vector_dedup.oracle(),
        "op13_hard_negatives": hard_negatives.oracle(),
    }

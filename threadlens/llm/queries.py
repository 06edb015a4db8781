"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from threadlens.llm import (
    alignment,
    chat,
    decontaminate,
    embedding_dedup,
    language_id,
    licenses,
    line_dedup,
    packing,
    periodic,
    quality,
    secret_scan,
    simhash_dedup,
    warc,
)
from threadlens.llm.common import table


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs)


def op2_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(table(spark, folder, "embeddings"))


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return decontaminate.digest(decontaminate.find_contamination(docs, table(spark, folder, "benchmark"), ["doc_id"]))


def op5_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash_dedup.simhash_classes(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash_dedup.hex16().alias("fingerprint"), "component_id")


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Values are shown as digests."""
    found = secret_scan.scan_secrets(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "start", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), "score", "is_secret"
    )


def op8_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return chat.rotate(table(spark, folder, "conversations"))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    told = language_id.identify(docs, language_id.learn(docs), ["doc_id"])
    return told.select("doc_id", (language_id.fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages")).drop("url")


def op11_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align_documents(table(spark, folder, "documents"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.digest(periodic.periodic_runs(periodic.planted(table(spark, folder, "documents")), ["doc_id"]))


def op13_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents"), table(spark, folder, "labels"), ["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_embedding_near_dedup,
        op3_best_fit_packing,
        op4_benchmark_decontamination,
        op5_simhash_near_dedup,
        op6_license_scan,
        op7_secret_scan,
        op8_chat_formatting,
        op9_language_id,
        op10_warc,
        op11_tokenizer_alignment,
        op12_periodic_runs,
        op13_quality_rules,
    )
} | {"pipeline": corpus_pipeline.run}

SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.SQL,
    "op4_benchmark_decontamination": decontaminate.SQL,
    "op8_chat_formatting": chat.SQL,
    "op10_warc": warc.SQL,
}

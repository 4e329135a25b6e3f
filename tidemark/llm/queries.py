"""The registered queries of the training-data operators, one per operator.

Each takes (spark, sf_dir), applies its operator with production parameters to the whole
intended table and returns the full result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    chat_format, decontaminate, divergence, line_dedup, mixing, oracle, quality_rules, secrets, simhash, spelling, toxicity,
    url_filters, warc, weak_quality,
)
from tidemark.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document rates for the targets of ``mixing.TARGETS``."""
    domains = mixing.labelled(table(spark, sf_dir, "labels"))
    return mixing.mix(table(spark, sf_dir, "documents"), domains)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its repeats cut out."""
    found = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "__cut.runs", F.col("__cut.words").alias("words_cut"), "text")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged capture history of archives written from ``pages``."""
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return warc.captures(table(spark, sf_dir, "pages")).select(*names)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.found_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations with derived tool calls, linked, ordered, validated and serialised."""
    return chat_format.formatted(chat_format.with_tools(table(spark, sf_dir, "conversations")), chat_format.TOOLS)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents")).drop("failed")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filters.evaluate(url_filters.captured(pages), url_filters.listed(pages))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tagger = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, tagger)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.classify(table(spark, sf_dir, "documents"))


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scanned(table(spark, sf_dir, "documents")))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_warc": op4_warc,
    "op5_decontamination": op5_decontamination,
    "op6_chat_format": op6_chat_format,
    "op7_quality_rules": op7_quality_rules,
    "op8_url_filters": op8_url_filters,
    "op9_toxicity": op9_toxicity,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_secret_scans": op11_secret_scans,
    "op12_source_divergence": op12_source_divergence,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = oracle.SQL

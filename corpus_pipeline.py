"""A corpus cleaning pipeline over the ``documents`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, line_dedup, mixing, simhash, toxicity
from tidemark.llm.common import table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger calls toxic go."""
    tagger = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, tagger)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of passages are cut; documents that were nothing else go."""
    return line_dedup.without_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays."""
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left, whole, with their rates for the target weights."""
    return mixing.mix(docs, mixing.labelled(table(spark, sf_dir, "labels")), keep=tuple(docs.columns))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeats),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", without_benchmark),
    ("mixing", mixed),
]

#: SQL cannot express trained taggers and iterative fits; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each reads what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

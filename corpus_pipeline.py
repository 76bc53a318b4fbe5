"""Cleaning a corpus: five stages over the ``documents`` table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as parquet in the shared checkpoint folder and reads it back as the next
stage's input, so a lost executor costs one stage at most.  All but the last return
the columns of ``documents``, whatever further columns the table has.

Null or empty texts and texts under 50 words are rejected by the first stage; an
empty table passes through all stages as an empty table.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, mixing, near_dedup, quality, secret_ledger
from tidemark.llm.tables import table, written
from tidemark.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and the forest."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word window of a benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets redacted."""
    return secret_ledger.redact(docs, scratch_path(spark, "pipeline-ledger"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards the target weights of their sources, shuffled."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("source mixing", source_mix),
]

ORACLE_SQL = None       # the forest of the first stage is not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs

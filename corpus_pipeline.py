"""A training corpus from raw documents: five stages, each an operator over all that its predecessor kept.

Defined results: a null or empty text has the toxicity score of one without savings, no copies and no benchmark window, and is
mixed and sharded like others, with no words and 16 bytes; a row without a doc_id is kept by near-dedup; texts of any length are read whole;
repeated rows are one document for near-dedup, all of which stay or go; without labels nothing is toxic; an empty table
gives an empty corpus; all columns of ``documents`` are carried, whatever their names, and the last stage adds its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow import scratch
from folioflow.llm import decontamination, mixing, near_dedup, sharding, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    return toxicity.clean_documents(docs, scratch.table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.kept_documents(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontamination.clean_documents(docs, scratch.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share of words asks for."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard."""
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Compression distance and trained models have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = scratch.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

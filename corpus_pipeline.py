"""Corpus pipeline: stages over whole documents, each written as Parquet and read again for the next.

Language ID rejects documents whose language can't be told or that no learned one parses; near dedup keeps one document of each group
of near copies by SimHash (op4: 4 or fewer differing bits), then of those by five-word shingles (Jaccard similarity of 0.8 or more); decontamination drops documents that hold a window of a benchmark item; mixing
repeats or leaves out documents so that sources come near their target weights; sharding, last, puts
every row into a shard with a gapless slot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from genoloom.llm import simhash
from genoloom.llm.common import documents, materialize
from genoloom.llm.decontam import decontaminate
from genoloom.llm.langid import fit, fold, identified
from genoloom.llm.mixing import mixed_documents
from genoloom.llm.neardup import deduplicate
from genoloom.llm.sharding import shard


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose text has no letter to tell a language by, or that no learned language parses."""
    return identified(docs, fit(docs, fold(3) != 1))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of op4's SimHash links; of what is left, one of each component of near copies by exact shingle sets, most of which 4 bits miss."""
    return deduplicate(materialize(simhash.deduplicate(docs), "simhash"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document row."""
    return shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to packed token sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scanlake.llm import divergence, mixing, packing, phrases, probminhash, text
from scanlake.session import remove_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the divergence rules."""
    return divergence.rules_stage(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return probminhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages of 50 words or more that an earlier one has."""
    return phrases.phrases_stage(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks."""
    return mixing.mix_stage(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("repeated_passages", repeated_passages), ("mix_sources", mix_sources), ("pack_sequences", pack_sequences),
]

#: Signatures and token ids cannot be expressed in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read back by the next, after which its table goes; the last one stays."""
    docs, before = text.load(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = text.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            remove_path(spark, before)
        before = docs.stored_at
    return docs

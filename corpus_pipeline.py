"""Documents to packed sequences: five stages, each one operator of strataframe.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataframe.llm import mixing, packing, quality, simhash, suffix_dedup
from strataframe.llm.common import lean_python, materialize, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    lean_python(spark)
    return quality.classify(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), keep=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest doc_id."""
    lean_python(spark)
    return simhash.keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long passages that repeat are cut from the texts."""
    lean_python(spark)
    return suffix_dedup.dedup(docs, keep=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target takes it."""
    return mixing.repeat(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens from all pieces; repeated documents are packed each."""
    lean_python(spark)
    return packing.pack(docs)


STAGES = [("quality classifier", classify), ("simhash near-dedup", near_dedup), ("suffix-array dedup", passages), ("mixing", mix), ("best-fit packing", pack)]
#: Models, fingerprints and tokenizers are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs

"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import html_text, mixing, mpegts, packing, quality, simhash, suffix_dedup, token_counts, warc
from .common import lean_python
from .common import table as _table


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    lean_python(spark)
    return _table(spark, sf_dir, name, *cols)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents", "doc_id", "text")).drop("removed")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op3_mpeg_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.store(table(spark, sf_dir, "documents", "doc_id", "text"), keep_media=False).drop("units")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_quality_rules, op3_mpeg_ts, op4_best_fit_packing, op5_html_extraction, op6_warc, op7_mixing, op8_simhash, op9_quality_classifier, op10_token_counts)}
#: The others cannot be expressed in SQL (hashes, archives of bytes, models, tokenizers); tests/llm holds them against brute force.
ORACLE_SQL = {"op6_warc": warc.SQL, "op7_mixing": mixing.SQL}

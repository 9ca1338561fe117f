"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import context_mixing, decontamination, exact_dedup, language_id, packing, phrases, pii, quality_classifier, quality_rules, simhash, token_alignment, token_planes, zip_warc
from .common import fresh_dir

#: Words whose ids a worker of these queries keeps, in each of two generations.
CACHED_WORDS = 500_000


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_quality_rules(_read(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no URL of a document: its source is the host, its language the path under it."""
    return quality_classifier.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_held_out(_read(spark, sf_dir, "documents"))


def op4_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = zip_warc.archive_pages(_read(spark, sf_dir, "pages"), fresh_dir(spark, "packages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_report(_read(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score_documents(_read(spark, sf_dir, "documents"))


def op8_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_planes.write_planes(_read(spark, sf_dir, "documents"), fresh_dir(spark, "token-planes"), public_tokenizers.path("word_bpe_49k.json"), cached_words=CACHED_WORDS)
    return token_planes.read_planes(manifest)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cached_words=CACHED_WORDS)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.link_report(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_duplicates(_read(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_language_id": op3_language_id,
    "op4_zip_warc": op4_zip_warc,
    "op5_personal_data": op5_personal_data,
    "op6_decontamination": op6_decontamination,
    "op7_context_mixing": op7_context_mixing,
    "op8_token_planes": op8_token_planes,
    "op9_simhash": op9_simhash,
    "op10_packing": op10_packing,
    "op11_token_alignment": op11_token_alignment,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op4_zip_warc": zip_warc.SQL,
    "op6_decontamination": decontamination.BRUTE_SQL,
    "op12_exact_dedup": exact_dedup.SQL,
    "op13_collocations": phrases.SQL,
}

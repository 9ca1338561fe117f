"""The corpus pipeline: from raw documents to packed sequences, in five written stages.

Every stage reads the five columns of ``documents`` and no other, so further
columns of any name are harmless and end with the first stage.  Any value may
be null, rows and ids may repeat, texts may be of any length, and an empty
table gives an empty table; what a stage does with such rows is in its text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, language_id, packing, pii, simhash
from tidemark.llm.common import join_checked, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _numbered(docs: DataFrame) -> DataFrame:
    """The stage's columns and a number per row, written first: ids may repeat or be null."""
    return stage(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "pipeline-rows")


def _without(rows: DataFrame, gone: DataFrame, label: str) -> DataFrame:
    """``rows`` without those whose number is in ``gone`` (one column)."""
    return join_checked(rows, stage(gone, label).toDF("row"), "row", "left_anti").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language spans are supported by at least one half, however many languages they have.

    The model is learned from the stage's own labelled rows, all but the
    held-out quarter that the operator's query keeps out as well.  Without any
    labelled row nothing speaks against a text that has a letter.  A null or
    empty text has no letter and goes; null labels teach nothing and are kept as
    they are; repeated rows are judged alike and all kept.
    """
    base = docs.select(*COLUMNS)
    model = language_id.learn(base.where(language_id.fold(F.col("doc_id"), 4) != 2))
    if not model.languages:
        return base.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.identify(base, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("support") >= 0.5)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of every SimHash component: the one with the smallest id, of several the first.

    A null id is larger than any other.  Texts without a word, null or empty,
    have the same fingerprint, so one of them stays.  Rows are removed by a
    number of their own, so a repeated id takes no other row along.
    """
    rows = _numbered(docs)
    return _without(rows, simhash.repeated_rows(rows, "row"), "pipeline-duplicates")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that hold at least 0.8 of the shingles of a ``benchmark`` item.

    A text without a word holds nothing and stays, and an item without a word
    drops nothing.  Repeated rows are dropped alike; without items all rows stay.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _numbered(docs)
    found = decontamination.find_contaminated(rows.select(F.col("row").alias("doc_id"), "text"), items).select("doc_id").distinct()
    return _without(rows, found, "pipeline-contaminated")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data in the texts; n_chars counts the new text.

    A null text stays null with its n_chars.  No row is dropped or merged.
    """
    masked = pii.mask_documents(docs.select(*COLUMNS))
    kind = docs.schema["n_chars"].dataType
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(kind))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the texts into sequences of at most 2048 token ids.

    A null or empty text is its end token alone; repeated rows are packed each;
    a text longer than a sequence is cut.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: SQL has neither the language model nor the tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from all of ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

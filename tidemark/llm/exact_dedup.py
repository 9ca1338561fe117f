"""Exact duplicates with a heavy-hitter split (operator 12).

Misra-Gries summaries of the digests find those that hold a large share of all
rows.  Their counts are verified, and the few that are left are broadcast, so
their rows never meet in one task.  All other digests are grouped by an
ordinary shuffle, in which no group is larger than a small share of the rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import giving_back, lower_ascii, stage

#: Counters of a summary.  A digest of more than three rows in so many of a table is found by its summaries.
COUNTERS = 2048


def misra_gries(counts: Counter, batch: Iterable, k: int) -> int:
    """Add a batch of keys to at most ``k`` counters; returns what was subtracted from each.

    With keys counted a batch at a time, one subtraction of the largest value
    that does not fit takes the place of one for every row.
    """
    counts.update(batch)
    if len(counts) <= k:
        return 0
    less = sorted(counts.values(), reverse=True)[k]
    for key in [key for key, n in counts.items() if n <= less]:
        del counts[key]
    for key in counts:
        counts[key] -= less
    return less


def frequent_digests(digests: DataFrame, k: int = COUNTERS) -> DataFrame:
    """(digest, at_least): every digest with more than 3 of ``k`` rows, at most ``k`` + 1 in all.

    Each task keeps a summary of ``k`` counters of its rows and hands on those
    above one ``k``-th of its rows; what is added up over tasks is short of the
    true count by at most two ``k``-ths of all rows.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = Counter(), 0
        for batch in batches:
            rows += batch.num_rows
            misra_gries(counts, batch["digest"].to_pylist(), k)
        some = [(d, n) for d, n in counts.items() if n * k > rows]
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in some], pa.binary()), pa.array([n for _, n in some], pa.int64()), pa.array([rows] * len(some), pa.int64())], ["digest", "n", "rows"])

    parts = digests.select("digest").mapInArrow(giving_back(summarise), "digest binary, n long, rows long")
    total = digests.count()
    return parts.groupBy("digest").agg(F.sum("n").alias("at_least")).where(F.col("at_least") * k >= total)


def _digests(docs: DataFrame) -> DataFrame:
    """A row per document: its number, id and digest.  Written, so that the texts are read once."""
    text = lower_ascii(F.coalesce("text", F.lit("")))
    return stage(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.unhex(F.sha2(text, 256)).alias("digest")), "digests")


def _order():
    """The row that stays is the largest by this: the highest id, a null one below all others, then the first row."""
    return F.struct(F.col("doc_id"), (-F.col("row")).alias("back"))


def groups_of(digests: DataFrame, k: int = COUNTERS) -> DataFrame:
    """(row, doc_id, digest, keep_id, keep_row, group_size) for rows with (row, doc_id, digest)."""
    heavy = stage(frequent_digests(digests, k), "frequent")
    whole = digests.join(F.broadcast(heavy.select("digest")), "digest")  # at most k + 1 rows of 32 bytes
    won = whole.groupBy("digest").agg(F.max(_order()).alias("keep"), F.count("*").alias("group_size"))
    winners = stage(won.where(F.col("group_size") * k >= digests.count()), "winners")
    columns = ["row", "doc_id", "digest", F.col("keep.doc_id").alias("keep_id"), (-F.col("keep.back")).alias("keep_row"), "group_size"]
    removed = digests.join(F.broadcast(winners), "digest").select(*columns)
    rest = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    group = Window.partitionBy("digest")
    ordinary = rest.withColumns({"keep": F.max(_order()).over(group), "group_size": F.count("*").over(group)}).select(*columns)
    return removed.unionByName(ordinary)


def find_duplicates(docs: DataFrame, k: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after lower-casing A-Z only; null counts as
    empty.  The row with the largest id stays; of repeated ids the first row, and
    a null id only where its group has no other.  An empty table has no groups;
    columns other than doc_id and text are not read.
    """
    found = groups_of(_digests(docs), k)
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def distinct_documents(docs: DataFrame, k: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    numbered = stage(docs.withColumn("_tidemark_row", F.monotonically_increasing_id()), "numbered")
    digest = F.unhex(F.sha2(lower_ascii(F.coalesce("text", F.lit(""))), 256))
    rows = stage(numbered.select(F.col("_tidemark_row").alias("row"), "doc_id", digest.alias("digest")), "digests")
    gone = groups_of(rows, k).where("row <> keep_row").select(F.col("row").alias("_tidemark_row"))
    return numbered.join(gone, "_tidemark_row", "left_anti").drop("_tidemark_row")


SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256 FROM t WINDOW g AS (PARTITION BY text_sha256)
"""

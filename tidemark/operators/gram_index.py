"""A persisted index of three-byte grams, so that a vocabulary reads only the texts that can match.

Every match of an expression holds certain literals; a text without all grams
of those literals has no match.  The index lists, per gram, the texts that have
it, as differences of ascending numbers.  It is built without a shuffle of
texts: tasks write the lists of a few megabytes each, sorted by gram, so a
frequent gram has many short rows and no task holds its whole list.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import running
from tidemark.operators.dialect import fold, needed_literals
from tidemark.operators.patterns import Pattern
from tidemark.operators.scan import candidates_of
from tidemark.sources.tables import stage

POSTINGS = "gram int, first long, deltas array<int>"
#: Text of one step of a task.
STEP_BYTES = 1 << 22


def grams_of(literal: str) -> set[int]:
    """The grams of a folded ASCII literal, as numbers."""
    data = literal.encode("ascii")
    return {data[i] << 16 | data[i + 1] << 8 | data[i + 2] for i in range(len(data) - 2)}


def _grams_in(text: str) -> np.ndarray:
    """The distinct ASCII grams of a text, folded."""
    data = np.frombuffer(fold(text).encode(), np.uint8).astype(np.int32)
    codes = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    return np.unique(codes[codes & 0x808080 == 0]) if len(data) > 2 else np.empty(0, np.int32)


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def posted() -> pa.RecordBatch:
        grams = np.concatenate([g for _, g in held])
        files = np.repeat(np.array([n for n, _ in held], np.int64), [len(g) for _, g in held])
        order = np.lexsort((files, grams))
        grams, files = grams[order], files[order]
        first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.empty(0, np.int64)
        deltas = np.diff(files, prepend=0)
        deltas[first] = 0
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(grams)).astype(np.int32)), pa.array(deltas.astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(grams[first].astype(np.int32)), pa.array(files[first]), lists], ["gram", "first", "deltas"])

    for batch in batches:
        for number, text in zip(batch["file_no"].to_pylist(), batch["text"].to_pylist()):
            if text:
                held.append((number, _grams_in(text)))
                size += len(text)
                if size >= STEP_BYTES:
                    yield posted()
                    held, size = [], 0
    if held:
        yield posted()


@dataclass(frozen=True)
class GramIndex:
    """``postings`` (gram, first, deltas) and ``files`` (file_no, key, n_bytes), both written tables."""

    postings: DataFrame
    files: DataFrame
    key: str


def build_index(texts: DataFrame, path: str, key: str = "file") -> GramIndex:
    """Write the index of (key, text) under ``path``, the URI of a folder that all executors share.

    A null text has no grams, and is never read through the index; an
    unreadable file has no match either.  Repeated keys are texts of their own.
    """
    numbered = stage(texts.select(F.monotonically_increasing_id().alias("file_no"), F.col(key), "text"), "numbered")
    numbered.select("file_no", key, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")).write.mode("overwrite").parquet(f"{path}/files")
    posted = numbered.select("file_no", "text").mapInArrow(_post, POSTINGS)
    posted.repartitionByRange("gram", "first").sortWithinPartitions("gram", "first").write.mode("overwrite").parquet(f"{path}/postings")
    return open_index(texts.sparkSession, path, key)


def open_index(spark: SparkSession, path: str, key: str = "file") -> GramIndex:
    """An index written before."""
    return GramIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/files"), key)


def needed_grams(patterns: Sequence[Pattern], unicode: bool = True) -> list[set[int]] | None:
    """Alternatives of grams: a text that matches has all of at least one; None if some match may have no gram."""
    out = []
    for p in patterns:
        for literals in needed_literals(p.regex, unicode):
            grams = set().union(*(grams_of(x) for x in literals))
            if not grams:
                return None
            out.append(grams)
    return out


def possible_files(index: GramIndex, patterns: Sequence[Pattern], unicode: bool = True) -> DataFrame:
    """(file_no, key, n_bytes): the texts that can match; all of them if the vocabulary has a pattern without grams.

    Only postings of the vocabulary's grams are read: the table is sorted by
    gram, and the grams reach the scan as a pushed filter.
    """
    wanted = needed_grams(patterns, unicode)
    if wanted is None:
        return index.files
    spark = index.files.sparkSession
    branches = spark.createDataFrame([(i, g, len(grams)) for i, grams in enumerate(wanted) for g in sorted(grams)], "branch int, gram int, of int")
    rows = index.postings.where(F.col("gram").isin(sorted(set().union(*wanted))))
    numbers = F.explode(F.transform(running(F.col("deltas"), lambda a, b: a + b), lambda d: F.col("first") + d)).alias("file_no")
    listed = rows.join(F.broadcast(branches), "gram").select("branch", "of", numbers)  # as many rows as the vocabulary has grams
    whole = listed.groupBy("branch", "of", "file_no").agg(F.count("*").alias("n")).where("n = of")
    return index.files.join(whole.select("file_no").distinct(), "file_no", "left_semi")


def indexed_candidates(texts: DataFrame, index: GramIndex, patterns: Sequence[Pattern], mode: str = "universal", unicode: bool = True) -> DataFrame:
    """:func:`~tidemark.operators.scan.candidates_of` of the texts that can match; the same rows as without the index."""
    keys = possible_files(index, patterns, unicode).select(index.key).distinct()
    return candidates_of(texts.join(keys, index.key, "left_semi"), patterns, index.key, mode, unicode)


def reading_report(index: GramIndex, patterns: Sequence[Pattern], unicode: bool = True) -> DataFrame:
    """One row: n_files and n_bytes of all texts, and read_files and read_bytes of those that can match."""
    of = lambda d, a, b: d.agg(F.count("*").alias(a), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias(b))
    return of(index.files, "n_files", "n_bytes").crossJoin(of(possible_files(index, patterns, unicode), "read_files", "read_bytes"))  # one row each

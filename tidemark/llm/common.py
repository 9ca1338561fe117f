"""Shared helpers: the cluster's shared folder, written intermediate tables, bounded joins."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regular expression of the characters that separate words.
SPACES = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach.

    It is the cluster's ``spark.checkpoint.dir``.  A temporary folder is made
    only in local mode, where that setting may be absent.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_dirs.setdefault(context.applicationId, tempfile.mkdtemp(prefix="tidemark-"))


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    Lost executors never repeat the work behind a staged table, and rows that
    depend on task order (ids, files) are fixed once written.
    """
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def giving_back(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same task function, which gives freed memory back to the system when a partition ends.

    Python workers live on between stages, and would keep the peak of one
    stage through the next.
    """

    def run(batches: Iterator) -> Iterator:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return run


def join_checked(big: DataFrame, small: DataFrame, on, how: str = "left", max_rows: int = 200_000) -> DataFrame:
    """Join with a staged ``small`` side: broadcast up to ``max_rows`` rows, shuffled beyond.

    The shuffled form leaves both sides to adaptive skew-join splitting.  Rows
    of ``small`` must be of fixed width, so that the row bound bounds bytes.
    """
    if small.limit(max_rows + 1).count() <= max_rows:
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, _UPPER, _UPPER.lower())


def words_of(text: Column) -> Column:
    """The words of a text: maximal runs without space, tab, or the line-break controls."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))

"""Sequence packing by minimum bin slack over bitset subset sums (operator 10)."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, stage
from .tokenizer import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def fill_window(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, taken from the multiset ``counts``, whose sum is as close below ``room`` as any subset's.

    The reachable sums are the bits of one integer.  A length with c copies is
    added in powers of two, so the number of steps grows with log c.  The
    search ends as soon as ``room`` itself is reachable; otherwise it has seen
    every subset.  Backtracking over the kept bitsets gives the copies used.
    """
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            k = min(k, left)
            steps.append((reach, length, k))
            reach |= (reach << (length * k)) & mask
            left, k = left - k, 2 * k
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for before, length, k in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * k
            total -= length * k
    return chosen


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in ``lengths``: the longest piece left opens a bin, the best subset fills it."""
    where: dict[int, list[int]] = {}
    for i, x in enumerate(lengths):
        where.setdefault(x, []).append(i)
    counts = {x: len(at) for x, at in where.items()}
    order, bins = sorted(counts), []

    def take(x: int) -> int:
        counts[x] -= 1
        if not counts[x]:
            del counts[x]
        return where[x].pop()

    while order:
        if order[-1] not in counts:
            order.pop()
            continue
        bin_ = [take(first := order[-1])]
        bins.append(bin_ + [take(x) for x in fill_window(counts, capacity - first)])
    return bins


def cut_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, cached_words: int) -> DataFrame:
    """Tokenize whole texts, add ``end_id`` and cut each document at multiples of ``capacity``."""

    def cut(batches):
        cached, end = encoder(tokenizer_path, cached_words), int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows = [[], [], [], [], []]
            texts = (text or "" for text in batch.column(1).to_pylist())
            for doc_id, ids in zip(batch.column(0).to_pylist(), cached.encode_all(texts)):
                ids += end
                for at in range(0, len(ids), 4 * capacity):
                    piece = ids[at : at + 4 * capacity]
                    for column, value in zip(rows, (doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(giving_back(cut), PIECES)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, window_pieces: int = 16384, cached_words: int = 200_000) -> DataFrame:
    """Pack the token ids of all documents into sequences of at most ``capacity`` ids.

    A document gives full pieces of ``capacity`` ids, each a sequence by
    itself, and one shorter rest.  Rests are dealt evenly into windows of
    about ``window_pieces`` pieces, whatever their documents; each window is
    packed by :func:`pack_lengths`, so padding is left in a window's last
    sequences only.  A sequence is padded to ``capacity`` by its reader.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    A null or empty text is the end id alone.  A null doc_id stays null.  Equal
    rows and equal ids are packed as documents of their own.  An empty table
    gives no rows.

    A worker keeps the ids of at most twice ``cached_words`` words, about 170
    bytes each, from task to task.
    """
    pieces = stage(cut_documents(docs, tokenizer_path, end_id, capacity, cached_words).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", 2 * F.col("uid") + 1).withColumn("offset", F.lit(0).cast("long"))
    rests = pieces.where(F.col("length") < capacity)
    # uid is a partition number and a row number within it; the latter deals rows evenly
    windows = max(1, -(-rests.count() // window_pieces))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        sequence, offset = np.zeros(len(pdf), "int64"), np.zeros(len(pdf), "int64")
        for n, bin_ in enumerate(pack_lengths(lengths.tolist(), capacity)):
            sequence[bin_] = 2 * ((int(pdf["window"].iat[0]) << 32) + n)
            offset[bin_] = np.cumsum(lengths[bin_]) - lengths[bin_]
        return pdf.drop(columns=["window", "uid"]).assign(sequence_id=sequence, offset=offset)

    packed = rests.withColumn("window", F.pmod(F.xxhash64("uid"), F.lit(windows))).groupBy("window").applyInPandas(pack, PIECES + ", sequence_id long, offset long")
    return packed.unionByName(full.select(*packed.columns))

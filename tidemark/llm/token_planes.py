"""Token-id files: fixed-size id blocks transposed into planes, each plane compressed by itself (operator 8).

A file is a run of chunks, then its document table, its chunk index and a
16-byte footer.  A chunk holds up to ``block`` ids, transposed into byte planes
(all first bytes, then all second bytes, ...) or bit planes; every plane is a
zstandard frame of its own.  The index gives each chunk's place, number of ids
and plane lengths, so that any block can be read by range.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import giving_back, stage
from .tokenizer import encoder

MAGIC = b"TMPLANE1"
MANIFEST = "part long, path string, n_docs long, n_ids long"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Transpose unsigned 32-bit ids into 4 byte planes or 32 bit planes, lowest first."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
    if kind == "byte":
        return [np.ascontiguousarray(x).tobytes() for x in octets]
    return [np.packbits(octet >> bit & 1, bitorder="little").tobytes() for octet in octets for bit in range(8)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """The inverse of :func:`to_planes`."""
    octets = np.zeros((n, 4), np.uint8)
    if kind == "byte":
        for i, plane in enumerate(planes):
            octets[:, i] = np.frombuffer(plane, np.uint8)
    else:
        for i, plane in enumerate(planes):
            octets[:, i // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little") << (i % 8)
    return octets.reshape(-1).view("<u4")


class PlaneWriter:
    """Writes one file; ids are held for one block only."""

    def __init__(self, out, block: int, kind: str, level: int):
        self.out, self.block, self.kind = out, block, kind
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.held, self.held_bytes, self.at, self.chunks, self.docs, self.n_ids = [], 0, 0, [], [], 0

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """Append a document's ids, given as little-endian unsigned 32-bit integers."""
        self.docs.append((doc_id, len(ids) // 4))
        self.n_ids += len(ids) // 4
        self.held.append(ids)
        self.held_bytes += len(ids)
        if self.held_bytes >= 4 * self.block:
            joined, step = b"".join(self.held), 4 * self.block
            whole = len(joined) - len(joined) % step
            for k in range(0, whole, step):
                self._chunk(joined[k : k + step])
            self.held, self.held_bytes = [joined[whole:]], len(joined) - whole

    def _chunk(self, data: bytes) -> None:
        ids, start = np.frombuffer(data, "<u4"), self.at
        self.chunks.append((start, len(ids), [self._put(self.compress(p)) for p in to_planes(ids, self.kind)]))

    def close(self) -> None:
        if self.held_bytes:
            self._chunk(b"".join(self.held))
        table = (self.at, self._put(self.compress(json.dumps(self.docs).encode())))
        index = self.compress(json.dumps({"block": self.block, "planes": self.kind, "chunks": self.chunks, "docs": table}).encode())
        self._put(index)
        self._put(struct.pack("<Q", len(index)) + MAGIC)


class PlaneFile:
    """Random access to one file through its chunk index."""

    def __init__(self, source):
        self.source, size = source, source.size()
        self.decompress = zstandard.ZstdDecompressor().decompress
        length, magic = struct.unpack("<Q8s", self._at(size - 16, 16))
        if magic != MAGIC:
            raise ValueError("not a token plane file")
        index = json.loads(self.decompress(self._at(size - 16 - length, length)))
        self.kind, self.chunks, table = index["planes"], index["chunks"], index["docs"]
        self.docs = json.loads(self.decompress(self._at(*table)))

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def chunk(self, k: int) -> np.ndarray:
        """The ids of block ``k``."""
        start, n, lengths = self.chunks[k]
        data, planes, at = self._at(start, sum(lengths)), [], 0
        for length in lengths:
            planes.append(self.decompress(data[at : at + length]))
            at += length
        return from_planes(planes, n, self.kind)

    def documents(self) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, start within the file, ids) of every document, one block in memory at a time."""
        held, k, start = b"", 0, 0
        for doc_id, n in self.docs:
            parts, need = [], 4 * n
            while need > len(held):
                parts.append(held)
                need -= len(held)
                held, k = self.chunk(k).tobytes(), k + 1
            parts.append(held[:need])
            held = held[need:]
            yield doc_id, start, b"".join(parts)
            start += n


def filesystem(uri: str):
    """File system and path of a URI or an absolute path."""
    return pyarrow.fs.FileSystem.from_uri(uri)


def write_planes(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int = 2, block: int = 65536, planes: str = "byte", level: int = 1, file_chars: int = 1 << 24, cached_words: int = 200_000) -> DataFrame:
    """Encode whole texts and write them in ascending doc_id order; returns the manifest, one row per file.

    Files are ranges of doc_id and a hash of the text, of about ``file_chars``
    characters each however many rows share an id, so reading them by ``part``
    gives the global order.  Each task attempt writes a file name of its own
    and only the files of finished tasks are in the manifest, so a repeated
    task does no harm.  Null texts are empty, null ids come first, equal ids
    are ordered by the hash, then by text.

    A worker keeps the ids of at most twice ``cached_words`` words, about 170
    bytes each, from task to task.
    """

    def write(batches):
        cached, end, target, writer, out = encoder(tokenizer_path, cached_words), int(end_id).to_bytes(4, "little"), None, None, None
        for batch in batches:
            texts = (text or "" for text in batch.column(1).to_pylist())
            for doc_id, ids in zip(batch.column(0).to_pylist(), cached.encode_all(texts)):
                if writer is None:
                    fs, root = filesystem(out_dir)
                    fs.create_dir(root, recursive=True)
                    part = TaskContext.get().partitionId()
                    target = f"ids-{part:06d}-{uuid.uuid4().hex}.planes"
                    out = fs.open_output_stream(f"{root}/{target}")
                    writer = PlaneWriter(out, block, planes, level)
                writer.add(doc_id, ids + end)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{out_dir}/{target}"], "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids]})

    chars, = docs.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)) + F.count("*")).first()
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    ordered = rows.repartitionByRange(max(1, -(-chars // file_chars)), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    return stage(ordered.mapInArrow(giving_back(write), MANIFEST), "plane-manifest")


def read_planes(manifest: DataFrame) -> DataFrame:
    """Per document, read from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it.  The running total is
    over the manifest, one short row per file.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as source:
                    rows = [(d, base + start, len(ids) // 4, zlib.crc32(ids)) for d, start, ids in PlaneFile(source).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = max(1, manifest.count())
    return placed.select("path", "base").repartition(files).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")

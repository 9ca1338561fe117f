"""Judged chunks as a Spark sink: every chunk is published when it is valid, and none that is there is asked again.

The store is a folder on a file system that all executors share, one JSON-lines
file per chunk, named by the hash of all that its verdicts depend on.  A task
looks there before it asks, writes under a name of its own attempt and then
moves the file over its final name.  So lost executors, repeated tasks and
failed runs repeat nothing that was published; two attempts of one task that
run at the same time may both ask, and then publish the same chunk.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


class Folder:
    """A folder by URI, with files that appear whole or not at all."""

    def __init__(self, uri: str):
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(uri)

    def has(self, name: str) -> bool:
        return self.fs.get_file_info(f"{self.root}/{name}").type == pyarrow.fs.FileType.File

    def exists(self) -> bool:
        return self.fs.get_file_info(self.root).type == pyarrow.fs.FileType.Directory

    def put(self, name: str, rows: list[dict], attempt: str) -> None:
        """Publish JSON lines; the partial file belongs to one attempt alone."""
        self.fs.create_dir(self.root, recursive=True)
        partial = f"{self.root}/_{name}.{attempt}.partial"
        with self.fs.open_output_stream(partial) as out:
            out.write("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows).encode("utf-8", "surrogatepass"))
        self.fs.move(partial, f"{self.root}/{name}")

    def sweep(self, run: str) -> None:
        """Delete what attempts of one run left unpublished."""
        chosen = pyarrow.fs.FileSelector(self.root, allow_not_found=True)
        for info in self.fs.get_file_info(chosen):
            if info.base_name.startswith("_") and info.base_name.endswith(".partial") and f".{run}-" in info.base_name:
                self.fs.delete_file(info.path)


@dataclass(frozen=True)
class Work:
    """What a chunk is to the store: its name, and how to get its rows; ``log`` takes (name, rows) of each call made for it."""

    name: Callable[[list[dict]], str]
    rows: Callable[[int, list[dict], Callable[[str, list[dict]], None]], list[dict]]


@dataclass
class _Written(WriterCommitMessage):
    chunks: int
    asked: int


class _Writer(DataSourceWriter):
    def __init__(self, store: str, calls: str | None, work: Work):
        self.store, self.calls, self.work, self.run = store, calls, work, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, attempt = Folder(self.store), f"{self.run}-{TaskContext.get().taskAttemptId()}"
        calls = Folder(self.calls) if self.calls else None
        chunks = asked = 0
        for row in iterator:
            sites = sorted((c.asDict() for c in row.sites), key=lambda c: (c["file"], c["line"]))
            name = f"chunk-{self.work.name(sites)}.json"
            chunks += 1
            if not store.has(name):
                asked += 1
                log = lambda call, rows: calls and calls.put(f"call-{call}.json", rows, attempt)
                store.put(name, self.work.rows(row.chunk_id, sites, log), attempt)
        return _Written(chunks, asked)

    def commit(self, messages: list) -> None:
        """Note what the run did: small, and the last thing written."""
        done = [m for m in messages if m is not None]
        Folder(self.store).put(f"_run-{self.run}", [{"chunks": sum(m.chunks for m in done), "asked": sum(m.asked for m in done)}], "commit")

    def abort(self, messages: list) -> None:
        """Published chunks stay, since each is valid by itself."""
        for folder in filter(None, (self.store, self.calls)):
            Folder(folder).sweep(self.run)


def write_chunks(chunks: DataFrame, store: str, work: Work, calls: str | None = None) -> None:
    """Judge and publish chunks (chunk_id, sites array<struct<file, line, ...>>), those in the store excepted."""

    class ChunkStore(DataSource):
        @classmethod
        def name(cls) -> str:
            return "tidemark_chunks"

        def writer(self, schema, overwrite) -> DataSourceWriter:
            return _Writer(store, calls, work)

    chunks.sparkSession.dataSource.register(ChunkStore)
    chunks.select("chunk_id", "sites").write.format("tidemark_chunks").mode("append").save()

"""A source tree as a Spark data source.

Spark's file sources skip names that start with ``_`` or ``.``, so they lose
``__init__.py``; this source walks the tree itself.  It can only read.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith


def list_sources(root: str, suffix: str = ".py", prefixes: tuple[str, ...] = ()) -> list[str]:
    """Relative paths with ``suffix``, sorted; links are followed, directories named ``.x`` are not entered.

    ``prefixes`` keeps only these files and what lies below these directories.
    A link back to a directory above it is not entered.
    """
    found, above = [], {}
    for folder, names, files in os.walk(root, followlinks=True):
        real = os.path.realpath(folder)
        if real in above.get(os.path.dirname(folder), ()):
            names[:] = []
            continue
        above[folder] = {*above.get(os.path.dirname(folder), ()), real}
        names[:] = sorted(n for n in names if not n.startswith("."))
        found += [os.path.relpath(os.path.join(folder, f), root).replace(os.sep, "/") for f in files if f.endswith(suffix)]
    if prefixes:
        found = [f for f in found if any(f == p or f.startswith(p.rstrip("/") + "/") for p in prefixes)]
    return sorted(found)


def list_uri(uri: str, suffix: str = ".py") -> list[tuple[str, int]]:
    """(relative path, bytes) of files with ``suffix`` under the URI of a folder, sorted; names below ``.x`` folders are left out."""
    fs, root = pyarrow.fs.FileSystem.from_uri(uri)
    root = root.rstrip("/")
    found = [(f.path[len(root) + 1 :], f.size) for f in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)) if f.type == pyarrow.fs.FileType.File]
    return sorted((p, n) for p, n in found if p.endswith(suffix) and not any(d.startswith(".") for d in p.split("/")[:-1]))


def even_parts(sizes: list[tuple[str, int]], target: int, least: int = 1) -> list[list[str]]:
    """Paths dealt into parts of about ``target`` bytes, the largest file first, each to the smallest part.

    No part is larger than the mean and one file more, so none is above twice
    the mean unless a single file is larger than the mean.
    """
    total = sum(n for _, n in sizes)
    parts = min(max(-(-total // target), least, 1), max(len(sizes), 1))
    heap = [(0, i) for i in range(parts)]
    out: list[list[str]] = [[] for _ in range(parts)]
    for path, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        held, i = heapq.heappop(heap)
        out[i].append(path)
        heapq.heappush(heap, (held + n, i))
    return [sorted(p) for p in out]


class _Paths(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


#: What is pushed to the listing: filters on the path alone.
_TESTS: dict[type, Callable[[Filter], Callable[[str], bool]]] = {
    EqualTo: lambda f: lambda path: path == f.value,
    In: lambda f: set(f.value).__contains__,
    StringStartsWith: lambda f: lambda path: path.startswith(f.value),
    StringEndsWith: lambda f: lambda path: path.endswith(f.value),
}


class SourceTreeReader(DataSourceReader):
    """Reads parts of about ``bytes_per_task``; an unreadable file is a row with ``error`` and no text.

    Filters on the path - equal to one or several, a prefix, a suffix - are
    applied while files are listed, so what they exclude is never opened.
    """

    def __init__(self, options):
        self.root = options["path"]
        self.suffix = options.get("suffix", ".py")
        self.prefixes = tuple(p for p in options.get("prefixes", "").split(",") if p)
        self.per_task = int(options.get("bytes_per_task", str(16 << 20)))
        self.least = int(options.get("min_partitions", "1"))
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute == ("file",) and f.value is not None:
                self.tests.append(f)
            else:
                yield f

    def listed(self) -> list[tuple[str, int]]:
        """(path, bytes) of what the filters leave."""
        if "://" in self.root:
            sizes = list_uri(self.root, self.suffix)
            if self.prefixes:
                sizes = [(f, n) for f, n in sizes if any(f == p or f.startswith(p.rstrip("/") + "/") for p in self.prefixes)]
        else:
            sizes = [(f, self._size(f)) for f in list_sources(self.root, self.suffix, self.prefixes)]
        tests = [_TESTS[type(f)](f) for f in self.tests]
        return [(f, n) for f, n in sizes if all(t(f) for t in tests)]

    def _size(self, path: str) -> int:
        try:
            return os.path.getsize(os.path.join(self.root, path))
        except OSError:
            return 0

    def partitions(self):
        return [_Paths(paths) for paths in even_parts(self.listed(), self.per_task, self.least)]

    def read(self, partition) -> Iterator[tuple]:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.root) if "://" in self.root else (None, self.root)
        for path in partition.paths:
            try:
                if fs:
                    with fs.open_input_stream(f"{root.rstrip('/')}/{path}") as f:
                        text = f.read().decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
                else:
                    with open(os.path.join(root, path), encoding="utf-8", errors="replace") as f:
                        text = f.read()
                yield path, text, None
            except OSError as error:
                yield path, None, f"{type(error).__name__}: {error.strerror or error}"


class SourceTree(DataSource):
    """Format ``source_tree``: option path (a folder or its URI), and suffix, prefixes (comma-separated), bytes_per_task, min_partitions."""

    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return "file string, text string, error string"

    def reader(self, schema):
        return SourceTreeReader(self.options)


def read_tree(spark: SparkSession, root: str, **options) -> DataFrame:
    """(file, text, error) of a source tree on a file system that all executors see.

    Turns the session's filter pushdown for Python sources on, so that filters
    on ``file`` reach the listing.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").options(**options).load(root)


def check_apart(repo: str, workdir: str) -> None:
    """Raise if either directory is or contains the other, links resolved."""
    a, b = os.path.realpath(repo), os.path.realpath(workdir)
    if os.path.commonpath([a, b]) in (a, b):
        raise ValueError(f"{workdir} and {repo} overlap")


def check_inputs(repo: str, guide: str, workdir: str) -> None:
    """Raise unless the tree and a non-empty guide exist and the work directory is outside the tree."""
    if not os.path.isdir(repo):
        raise ValueError(f"no directory {repo}")
    if not os.path.isfile(guide):
        raise ValueError(f"no file {guide}")
    with open(guide, encoding="utf-8", errors="replace") as f:
        if not f.read().strip():
            raise ValueError(f"{guide} is empty")
    check_apart(repo, workdir)

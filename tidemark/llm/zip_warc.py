"""WARC records inside ZIP packages, read by range without extraction (operator 4).

A package stores (does not compress) its members: ``archive/data.warc.gz``,
one gzip member per record, and ``indexes/index.cdxj``, the place of every
record in it.  The reader parses the end of the file, the ZIP64 directory where
there is one, the central directory and the members' local headers, and then
reads the index and the records it lists by byte range.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_checked, stage

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_U32, _U16 = 0xFFFFFFFF, 0xFFFF


@dataclass(frozen=True)
class Member:
    """A stored or compressed member: where its local header is and how long its data is."""

    name: str
    method: int
    header: int
    size: int


class ZipReader:
    """Directory and range reads of a ZIP file, given ``read(offset, length)`` and its size."""

    def __init__(self, read, size: int):
        self.read, self.size = read, size
        tail_at = max(0, size - 22 - _U16)
        tail = read(tail_at, size - tail_at)
        at = tail.rfind(b"PK\5\6")
        while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
            at = tail.rfind(b"PK\5\6", 0, at)  # the same bytes inside the comment
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
        if _U16 in (count,) or _U32 in (length, start):
            locator = read(tail_at + at - 20, 20)
            if locator[:4] != b"PK\6\7":
                raise ValueError("no ZIP64 locator")
            (where,) = struct.unpack("<Q", locator[8:16])
            end = read(where, 56)
            if end[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack("<QQQ", end[32:56])
        self.members = {m.name: m for m in self._directory(read(start, length), count)}

    @staticmethod
    def _directory(data: bytes, count: int) -> Iterator[Member]:
        at = 0
        for _ in range(count):
            if data[at : at + 4] != b"PK\1\2":
                raise ValueError("broken central directory")
            flags, method = struct.unpack("<HH", data[at + 8 : at + 12])
            packed, plain, n_name, n_extra, n_comment = struct.unpack("<IIHHH", data[at + 20 : at + 34])
            (header,) = struct.unpack("<I", data[at + 42 : at + 46])
            name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, k = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
            while k + 4 <= len(extra):
                tag, n = struct.unpack("<HH", extra[k : k + 4])
                if tag == 1:  # ZIP64: only the fields that overflowed, in this order
                    wide, p = extra[k + 4 : k + 4 + n], 0
                    values = []
                    for value in (plain, packed, header):
                        if value == _U32:
                            (value,) = struct.unpack("<Q", wide[p : p + 8])
                            p += 8
                        values.append(value)
                    plain, packed, header = values
                k += 4 + n
            yield Member(name, method, header, packed)
            at += 46 + n_name + n_extra + n_comment

    def data_offset(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        member = self.members[name]
        if member.method != 0:
            raise ValueError(f"{name} is compressed, so it has no ranges")
        local = self.read(member.header, 30)
        if local[:4] != b"PK\3\4":
            raise ValueError(f"no local header of {name}")
        n_name, n_extra = struct.unpack("<HH", local[26:30])
        return member.header + 30 + n_name + n_extra

    def stored(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        """Bytes ``offset`` to ``offset + length`` of a stored member."""
        size = self.members[name].size
        return self.read(self.data_offset(name) + offset, size - offset if length is None else length)


def _line(value) -> str:
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record, gzipped by itself: a response, or a revisit if it refers to another page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_line(url or 'about:blank')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    gzip = zlib.compressobj(1, zlib.DEFLATED, 31)
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + gzip.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (names in lower case) and payload of one gzipped record."""
    plain = zlib.decompress(data, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    fields = lambda x: {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in x.decode().split("\r\n")[1:])}
    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def _page(urn: str | None) -> int | None:
    number = urn[len("<urn:page:") : -1] if urn else ""
    return int(number) if number else None


class _Sink:
    """An output that zipfile cannot seek, so that it streams."""

    def __init__(self, out):
        self.write, self.flush = out.write, lambda: None


def mark_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """(page_id, url, html, digest, refers_to): equal payloads refer to the largest page_id among them."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").withColumn("digest", F.sha1(payload))
    long_rows = rows.where(F.octet_length(payload) >= least_bytes)
    firsts = stage(long_rows.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "payload-groups")
    other = ~F.col("page_id").eqNullSafe(F.col("first"))
    return join_checked(rows, firsts, "digest").select("page_id", "url", "html", "digest", F.when(other, F.col("first")).alias("refers_to"))


def write_packages(pages: DataFrame, out_dir: str, date: str = "1970-01-01T00:00:00Z", least_bytes: int = 1000) -> DataFrame:
    """Write one package per task; returns (path, records) of the packages of finished tasks.

    Every task attempt has a file name of its own.  Records stream to the
    file one by one; only the index is held.
    """

    def write(batches):
        package, target, index, at = None, None, [], 0
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if package is None:
                    fs, root = pyarrow.fs.FileSystem.from_uri(out_dir)
                    fs.create_dir(root, recursive=True)
                    target = f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.wacz"
                    out = fs.open_output_stream(f"{root}/{target}")
                    package = zipfile.ZipFile(_Sink(out), "w", zipfile.ZIP_STORED)
                    member = package.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
                record = warc_record(page_id, url, (html or "").encode(), digest, refers_to, date)
                member.write(record)
                index.append(json.dumps({"id": page_id, "offset": at, "length": len(record)}))
                at += len(record)
        if package is not None:
            member.close()
            package.writestr(zipfile.ZipInfo(INDEX), "\n".join(index))
            package.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{out_dir}/{target}"], "records": [len(index)]})

    return stage(mark_revisits(pages, least_bytes).mapInArrow(write, "path string, records long"), "packages")


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"


def read_packages(packages: DataFrame, fetch: int = 4 << 20) -> DataFrame:
    """One row per record of the packages (path), located by their directory and index.

    Neighbouring records are fetched in ranges of about ``fetch`` bytes.  The
    size and digest of a response are those of the payload read; a revisit
    carries those of the payload it refers to.
    """

    def read(batches):
        for path in (p for batch in batches for p in batch.column(0).to_pylist()):
            fs, name = pyarrow.fs.FileSystem.from_uri(path)
            with fs.open_input_file(name) as source:
                package = ZipReader(lambda offset, n, s=source: s.read_at(n, offset), source.size())
                entries = [json.loads(x) for x in package.stored(INDEX).decode().split("\n")]
                base, k = package.data_offset(DATA), 0
                while k < len(entries):
                    first, n = entries[k], 1
                    end = first["offset"] + first["length"]
                    while k + n < len(entries) and entries[k + n]["offset"] == end and end - first["offset"] < fetch:
                        end, n = end + entries[k + n]["length"], n + 1
                    data, rows = package.read(base + first["offset"], end - first["offset"]), []
                    for e in entries[k : k + n]:
                        start = e["offset"] - first["offset"]
                        warc, http, payload = parse_record(data[start : start + e["length"]])
                        kind = warc["warc-type"]
                        if kind == "response":
                            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        else:
                            size, digest = int(http["content-length"]), warc["warc-payload-digest"].removeprefix("sha1:")
                        rows.append((_page(warc["warc-record-id"]), size, digest, kind, _page(warc.get("warc-refers-to")), path.rpartition("/")[2], e["offset"]))
                    k += n
                    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                    names = [c.split()[0] for c in RECORDS.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return packages.select("path").repartition(max(1, packages.count())).mapInArrow(read, RECORDS)


def archive_pages(pages: DataFrame, out_dir: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) into packages and read every record back.

    Of records with equal payloads of at least 1000 bytes, that with the
    largest page_id is the response and the others are revisits of it; shorter
    payloads are all responses.  A null html is an empty payload, a null url is
    ``about:blank``, a null page_id stays null (and never is the target of a
    revisit).  Rows that repeat the largest page_id are all responses.  An
    empty table gives no package and no rows.
    """
    return read_packages(write_packages(pages, out_dir))


#: The records that the packages must give back.
SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
), g AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""

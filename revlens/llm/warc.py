"""WARC records in ZIP-packaged archives: a writer and a reader that never extracts.

The writer deduplicates payloads by SHA-1, gzips each WARC record by itself and stores the records and their index as
uncompressed members of ZIP archives in the shared folder, one or more a task, each under a name of its own, so that a retried task leaves no half
archive in the result: only the names in the manifest table count. The reader finds the central directory (through the ZIP64
records where they are present), locates the stored members, and range-reads the index and then the records.

Defined results: a null html is an empty payload; a null url gives a record without a target; a record without page_id refers to
none and is referred to by none; rows that share both page_id and payload are all responses if that page_id is the largest; an empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, materialize, new_path

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: An archive is closed when its payloads pass this size, or its index this many records.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 16 << 20, 50_000
#: The reader fetches neighbouring records together up to this size.
READ_BYTES = 4 << 20
#: Tasks that read; a task reads its archives one after another, so more archives than tasks only take longer.
READ_TASKS = 10_000
DATE = "2024-01-01T00:00:00Z"
_NAME = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit that keeps the HTTP headers and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_NAME}{'' if page is None else page}>"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]' + chr(39))}")
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_NAME}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (names in lower case) and the payload that the record holds."""

    def headers(block: bytes) -> dict[str, str]:
        lines = block.decode("utf-8", "replace").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}

    top, _, rest = record.partition(b"\r\n\r\n")
    warc = headers(top)
    body = rest[: int(warc["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return warc, headers(http), payload


class ArchiveWriter:
    """One archive; the records stream through, only the index is held."""

    def __init__(self, file):
        self.zip = zipfile.ZipFile(file, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True)
        self.index: list[str] = []
        self.offset = self.payload = 0

    def add(self, page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> None:
        data = gzip.compress(warc_record(page, url, payload, digest, refers_to), 3, mtime=0)
        self.member.write(data)
        entry = {"url": url, "digest": f"sha1:{digest}", "offset": self.offset, "length": len(data), "filename": RECORDS}
        self.index.append(f"{_NAME}{'' if page is None else page} {DATE} {json.dumps(entry)}\n")
        self.offset += len(data)
        self.payload += len(payload)

    def full(self) -> bool:
        return self.payload >= ARCHIVE_BYTES or len(self.index) >= ARCHIVE_RECORDS

    def close(self) -> int:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(self.index))
        self.zip.close()
        return len(self.index)


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int


class ArchiveReader:
    """A ZIP archive behind read_at(size, offset); its members must be stored."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        self.members = {m.name: m for m in self._directory()}

    def _read(self, offset: int, size: int) -> bytes:
        data = self.file.read_at(size, offset)
        if len(data) != size:
            raise ValueError("the archive is cut short")
        return data

    def _directory(self) -> Iterator[Member]:
        tail_size = min(self.size, 22 + 65535)
        tail_at = self.size - tail_size
        tail = self._read(tail_at, tail_size)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of central directory")
        count, size, at = struct.unpack("<H2I", tail[end + 10 : end + 20])
        locator = tail_at + end - 20
        if (count == 0xFFFF or size == 0xFFFFFFFF or at == 0xFFFFFFFF) and locator >= 0:
            mark, _, record_at, _ = struct.unpack("<4sIQI", self._read(locator, 20))
            if mark == b"PK\x06\x07":
                record = self._read(record_at, 56)
                if record[:4] != b"PK\x06\x06":
                    raise ValueError("no ZIP64 end of central directory")
                count, size, at = struct.unpack("<3Q", record[32:56])
        data, k = self._read(at, size), 0
        for _ in range(count):
            if data[k : k + 4] != b"PK\x01\x02":
                raise ValueError("a broken central directory")
            method = struct.unpack_from("<H", data, k + 10)[0]
            packed, full, n, extra, comment = struct.unpack_from("<2I3H", data, k + 20)
            header = struct.unpack_from("<I", data, k + 42)[0]
            name = data[k + 46 : k + 46 + n].decode("utf-8")
            more = data[k + 46 + n : k + 46 + n + extra]
            wide = self._zip64(more)
            sizes = []
            for value in (full, packed, header):  # in this order where they don't fit
                sizes.append(wide.pop(0) if value == 0xFFFFFFFF and wide else value)
            yield Member(name, method, sizes[1], sizes[2])
            k += 46 + n + extra + comment

    @staticmethod
    def _zip64(extra: bytes) -> list[int]:
        k = 0
        while k + 4 <= len(extra):
            kind, size = struct.unpack_from("<2H", extra, k)
            if kind == 1:
                return list(struct.unpack_from(f"<{min(size // 8, 3)}Q", extra, k + 4))
            k += 4 + size
        return []

    def start(self, name: str) -> int:
        """Where the bytes of a stored member begin."""
        member = self.members[name]
        if member.method != 0:
            raise ValueError(f"{name} is compressed; only stored members can be read in place")
        header = self._read(member.header, 30)
        if header[:4] != b"PK\x03\x04":
            raise ValueError("a broken local header")
        return member.header + 30 + sum(struct.unpack("<2H", header[26:30]))

    def records(self) -> Iterator[bytes]:
        """Each WARC record, unpacked, in the order of the index."""
        index = self._read(self.start(INDEX), self.members[INDEX].size).decode()
        base = self.start(RECORDS)
        entries = [json.loads(line.split(" ", 2)[2]) for line in index.split("\n") if line]
        k = 0
        while k < len(entries):
            at, end, n = entries[k]["offset"], entries[k]["offset"], k
            while n < len(entries) and entries[n]["offset"] == end and (n == k or end + entries[n]["length"] - at <= READ_BYTES):
                end += entries[n]["length"]
                n += 1
            data = self._read(base + at, end - at)
            for e in entries[k:n]:
                yield gzip.decompress(data[e["offset"] - at : e["offset"] - at + e["length"]])
            k = n


def _store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri)


def _qualified(spark: SparkSession, path: str) -> str:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(at).toString()


def write_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) -> the manifest (path, records), written when this returns. Among equal payloads of min_bytes or more the largest page_id
    is the response and the others revisit it."""
    spark = pages.sparkSession
    folder = _qualified(spark, new_path(spark, "archives"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), as_bytes("html").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    same = materialize(
        rows.filter(F.length("payload") >= min_bytes)
        .groupBy("sha")
        .agg(F.count("*").alias("n"), F.max("page_id").alias("keeper"))
        .filter("n > 1 AND keeper IS NOT NULL")
        .select(F.col("sha").alias("same"), "keeper"),
        "payloads",
    )
    eligible = (F.length("payload") >= min_bytes) & (F.col("sha") == F.col("same"))
    marked = rows.join(same, eligible, "left").select(
        "page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        archive = stream = path = None
        done: list[tuple[str, int]] = []

        def close() -> None:
            done.append((f"{folder}/{path}", archive.close()))
            stream.close()

        for batch in batches:
            for page, url, payload, refers_to in zip(*(batch.column(k) for k in range(4)), strict=True):
                if archive is None:
                    path = f"{uuid.uuid4().hex}.wacz"
                    stream = store.open_output_stream(f"{root}/{path}")
                    archive = ArchiveWriter(stream)
                data = payload.as_py()
                archive.add(page.as_py(), url.as_py(), data, payload_digest(data), refers_to.as_py())
                if archive.full():
                    close()
                    archive = None
        if archive is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "records"])

    return materialize(marked.mapInArrow(write, "path string, records long"), "manifest")


def _page(name: str | None) -> int | None:
    text = (name or "").strip("<>").removeprefix(_NAME)
    return int(text) if text else None


def read_archives(manifest: DataFrame) -> DataFrame:
    """manifest (path) -> page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for revisits). Digests of responses are
    computed from what was read and must agree with the record's."""
    archives = max(1, manifest.count())
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = [f.split()[0] for f in schema.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = _store(uri)
                rows, held = [], 0
                with store.open_input_file(path) as file:
                    for record in ArchiveReader(file).records():
                        warc, http, payload = parse_record(record)
                        digest, kind = warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"]
                        if kind == "response" and payload_digest(payload) != digest:
                            raise ValueError(f"{uri}: the payload of {warc['warc-record-id']} does not match its digest")
                        size = len(payload) if kind == "response" else int(http["content-length"])
                        rows.append((_page(warc["warc-record-id"]), warc.get("warc-target-uri"), kind, _page(warc.get("warc-refers-to")), size, digest, payload if kind == "response" else None))
                        held += len(payload)
                        if held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return manifest.select("path").repartitionByRange(min(archives, READ_TASKS), "path").mapInArrow(read, schema)

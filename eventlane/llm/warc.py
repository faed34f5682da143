"""WARC archives as a PySpark data source.

``spark.dataSource.register(WarcSource)``, then ``df.write.format("warc")``
and ``spark.read.format("warc")``. Writing makes record-per-member gzip files
(or plain ones) of bounded size and a list of the files that were committed, so
a lost task leaves nothing behind that is read. Reading plans partitions from
the file list, parses a record's header before anything else, and decodes a
payload only if the record passes the pushed filters and the payload is wanted.
"""

from __future__ import annotations

import base64
import gzip
import io
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, content_type string, "
    "payload binary, payload_length long, payload_digest string, refers_to string"
)
# Fixed values of the format.
_VERSION = b"WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FIELDS = {
    "warc-type": "record_type", "warc-record-id": "record_id", "warc-target-uri": "target_uri", "warc-date": "date",
    "warc-payload-digest": "payload_digest", "warc-refers-to": "refers_to",
}
FILE_LIST = "_files.json"
_CHUNK = 1 << 20


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _clean(value: str) -> str:
    """A header value on one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def base32_digest(hexadecimal: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def hex_digest(value: str) -> str:
    return base64.b32decode(value.partition(":")[2]).hex()


def record_bytes(row: dict) -> bytes:
    """One record: headers, and an HTTP response; a revisit holds the response's headers only."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    length = row["payload_length"] if row["payload_length"] is not None else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {_clean(row['content_type'] or 'application/octet-stream')}\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if revisit else http + payload
    named = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", row["date"]),
        ("WARC-Target-URI", row["target_uri"]), ("WARC-Payload-Digest", base32_digest(row["payload_digest"]) if row["payload_digest"] else None),
        ("WARC-Refers-To", f"<{row['refers_to']}>" if row["refers_to"] is not None else None), ("WARC-Profile", _PROFILE if revisit else None),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{name}: {_clean(value)}\r\n" for name, value in named if value is not None)
    return _VERSION + b"\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    """Writes each task's records to files of its own."""

    def __init__(self, path: str, compress: bool, most: int, schema: StructType) -> None:
        self.path, self.compress, self.most = path, compress, most
        self.absent = dict.fromkeys(name.split()[0] for name in SCHEMA.split(", "))
        # A folder has its list before any task writes: what a lost or failed attempt leaves is never in it.
        system, folder = open_path(path)
        system.create_dir(folder, recursive=True)
        if system.get_file_info(f"{folder}/{FILE_LIST}").type != fs.FileType.File:
            before = json.dumps(listed(path)).encode()
            with system.open_output_stream(f"{folder}/{FILE_LIST}") as out:
                out.write(before)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = open_path(self.path)
        files: list[tuple[str, int]] = []
        out, size = None, 0
        for batch in iterator:
            for start in range(0, batch.num_rows, 64):
                for row in batch.slice(start, 64).to_pylist():
                    data = record_bytes(self.absent | row)
                    data = gzip.compress(data, 6, mtime=0) if self.compress else data
                    if out is None or size + len(data) > self.most:
                        if out is not None:
                            out.close()
                            files[-1] = (files[-1][0], size)
                        files.append((f"{uuid.uuid4().hex}.warc" + ".gz" * self.compress, 0))
                        out, size = system.open_output_stream(f"{folder}/{files[-1][0]}", compression=None), 0
                    out.write(data)
                    size += len(data)
        if out is not None:
            out.close()
            files[-1] = (files[-1][0], size)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """List what was committed beside what is listed already; readers read nothing else."""
        system, folder = open_path(self.path)
        own = [f for m in messages if m for f in m.files]
        written = {name for name, _ in own}
        files = [f for f in listed(self.path) if f[0] not in written] + own
        with system.open_output_stream(f"{folder}/{FILE_LIST}") as out:
            out.write(json.dumps(sorted(files)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = open_path(self.path)
        for name in (f[0] for m in messages if m for f in m.files):
            system.delete_file(f"{folder}/{name}")


def listed(path: str) -> list[tuple[str, int]]:
    """Names and sizes of the archive files of a folder: the committed ones, or all where no list was written."""
    system, folder = open_path(path)
    info = system.get_file_info(f"{folder}/{FILE_LIST}")
    if info.type == fs.FileType.File:
        with system.open_input_stream(info.path) as file:
            return [tuple(f) for f in json.loads(file.read())]
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((f.base_name, f.size) for f in found if f.base_name.endswith((".warc", ".warc.gz")))


@dataclass
class Files(InputPartition):
    names: list[str]

    def __init__(self, names: list[str]) -> None:
        super().__init__(names)
        self.names = names


def parsed_headers(file: io.BufferedIOBase) -> dict[str, str] | None:
    """The headers of the record at the file's place, by lower-case name; None at the end."""
    line = file.readline()
    while line in (b"\r\n", b"\n"):
        line = file.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    headers: dict[str, str] = {}
    while (line := file.readline().rstrip(b"\r\n")) != b"":
        name, _, value = line.decode("utf-8", "replace").partition(":")
        headers[name.strip().lower()] = value.strip()
    return headers


def http_headers(file: io.BufferedIOBase) -> tuple[dict[str, str], int]:
    """The headers of an HTTP response, and the bytes they take."""
    size, headers = len(file.readline()), {}
    while True:
        line = file.readline()
        size += len(line)
        if not line.strip():
            return headers, size
        name, _, value = line.decode("utf-8", "replace").partition(":")
        headers[name.strip().lower()] = value.strip()


def records(file: io.BufferedIOBase, passes, wanted: bool) -> Iterator[dict]:
    """The records of a file that pass, with their payloads if wanted."""
    while (headers := parsed_headers(file)) is not None:
        length = int(headers["content-length"])
        row = {column: headers.get(name) for name, column in _FIELDS.items()}
        for name in ("record_id", "refers_to"):
            row[name] = row[name][1:-1] if row[name] else row[name]
        row["payload_digest"] = hex_digest(row["payload_digest"]) if row["payload_digest"] else None
        if passes(row):
            row |= {"content_type": headers.get("content-type"), "payload": None, "payload_length": length}
            used = 0
            if (row["content_type"] or "").startswith("application/http"):
                inner, used = http_headers(file)
                row["content_type"] = inner.get("content-type")
                row["payload_length"] = int(inner.get("content-length", length - used))
            if wanted and row["record_type"] != "revisit":
                row["payload"] = file.read(length - used)
                used = length
            file.seek(length - used, io.SEEK_CUR)
            yield row
        else:
            file.seek(length, io.SEEK_CUR)


class WarcReader(DataSourceReader):
    """Plans partitions of whole files; takes filters on the header columns."""

    def __init__(self, path: str, schema: StructType, split: int) -> None:
        self.path, self.split, self.filters = path, split, []
        self.columns = schema.names
        self.schema = schema

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            simple = isinstance(f, EqualTo | In | IsNotNull | StringStartsWith)
            if simple and len(f.attribute) == 1 and f.attribute[0] in _FIELDS.values():
                self.filters.append(f)
            else:
                yield f

    def passes(self, row: dict) -> bool:
        for f in self.filters:
            value = row[f.attribute[0]]
            if value is None or (isinstance(f, EqualTo) and value != f.value) or (isinstance(f, In) and value not in f.value):
                return False
            if isinstance(f, StringStartsWith) and not value.startswith(f.value):
                return False
        return True

    def partitions(self) -> Sequence[InputPartition]:
        """Files in the order of their names, small ones together up to the split size."""
        found, room = [[]], self.split
        for name, size in sorted(listed(self.path)):
            if found[-1] and size > room:
                found.append([])
                room = self.split
            found[-1].append(name)
            room -= size
        return [Files(names) for names in found]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, folder = open_path(self.path)
        schema = pa.schema([(f.name, {"binary": pa.binary(), "bigint": pa.int64()}.get(f.dataType.simpleString(), pa.string())) for f in self.schema])
        held, size = [], 0
        for name in partition.names:
            with system.open_input_file(f"{folder}/{name}") as raw:
                for row in records(io.BufferedReader(gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else _Plain(raw), _CHUNK), self.passes, "payload" in self.columns):
                    held.append({c: row[c] for c in self.columns})
                    size += len(row["payload"] or b"")
                    if len(held) >= 1000 or size >= 8 * _CHUNK:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)


class _Plain(io.RawIOBase):
    """A file of any file system as a raw stream; skipping a block reads none of it."""

    def __init__(self, raw) -> None:
        self.raw = raw

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.raw.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def seek(self, offset: int, whence: int = 0) -> int:
        self.raw.seek(offset if whence == 0 else self.raw.tell() + offset if whence == 1 else self.raw.size() + offset)
        return self.raw.tell()

    def tell(self) -> int:
        return self.raw.tell()


class WarcSource(DataSource):
    """Options: ``path``; ``compression`` (gzip or none); ``maxFileBytes``; ``splitBytes``.

    A read schema without ``payload`` skips all payloads. Null values make no
    header; a null payload is empty; an empty table makes no file and reads
    back empty; repeated rows make repeated records; columns that are not of
    the schema are not written.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("splitBytes", 64 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only appended to")
        gzipped = self.options.get("compression", "gzip") != "none"
        return WarcWriter(self.options["path"], gzipped, int(self.options.get("maxFileBytes", 256 << 20)), schema)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed down."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

"""Archived responses as a Spark data source: WARC files, pruned by day and host.

    register(spark)
    pages.write.format("warc").mode("append").save(root)          # url, day, status, headers, body
    responses(spark, root, since="2026-01-02", hosts=["a.example.com"])

A file holds the records of one day and one of BUCKETS hashes of the host, each record a gzip member of
its own, as WARC asks:

    <root>/day=2026-01-02/bucket=07/<name>.warc.gz

Days and hosts are options of a load: files of other days and buckets are not planned, and records of other
hosts are passed over before their bodies are parsed. They are not taken from filters, since Spark 4.1
keeps the filters that it pushed for one use of a loaded frame for all others, which then lack rows. A
split is a file, so the driver reads names only; large days make many files, one for each task that wrote
them. Files are written aside and moved into place when the job commits. The root is any path that
pyarrow's file systems know and that driver and executors share.

Defined cases: a null url, day or body is written as empty and read as null; a null status is none; header
names and values come back as they were written, but for line breaks in them, which become spaces; other
record types than responses are skipped; a file that breaks off raises an error; an empty root has no rows.
"""

from __future__ import annotations

import gzip
import io
import json
import posixpath
import re
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "url string, host string, day date, status int, headers map<string,string>, body binary"
BUCKETS = 64
NO_DAY = "none"


def host_of(url: str | None) -> str | None:
    """The lower-case host of a URL, without user and port; None where there is none."""
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)", url or "")
    return m[1].lower() or None if m else None


def bucket_of(host: str | None) -> int:
    return zlib.crc32((host or "").encode()) % BUCKETS


def _fs(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def record(url: str | None, day: date | None, status: int | None, headers: dict[str, str] | None, body: bytes | None) -> bytes:
    """One response as a gzip member."""
    flat = lambda x: re.sub(r"[\r\n]+", " ", x or "")
    head = "".join(f"{flat(k)}: {flat(v)}\r\n" for k, v in (headers or {}).items())
    http = (f"HTTP/1.1 {status if status is not None else '-'}\r\n{head}\r\n").encode() + (body or b"")
    marks = ("" if url is not None else "null-url ") + ("" if body is not None else "null-body ") + ("" if headers is not None else "null-headers")
    warc = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Target-URI: {flat(url)}\r\nWARC-Date: {f'{day}T00:00:00Z' if day else ''}\r\nX-Marks: {marks}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n"
    return gzip.compress(warc.encode() + http + b"\r\n\r\n", 6)


def _fields(lines: list[str]) -> dict[str, str]:
    return {k: v.strip(" ") for k, _, v in (x.partition(":") for x in lines)}


def records(stream: io.BufferedIOBase, hosts: frozenset[str | None] | None = None) -> Iterator[tuple]:
    """The responses of a WARC file whose host is one of hosts."""
    while first := stream.readline():
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError("this is no WARC record")
        lines = []
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            lines.append(line.decode("utf-8", "replace").rstrip("\r\n"))
        warc = _fields(lines)
        size = int(warc.get("Content-Length", -1))
        block = stream.read(size) if size >= 0 else b""
        if size < 0 or len(block) != size:
            raise ValueError("a WARC record breaks off")
        if warc.get("WARC-Type") != "response":
            continue
        marks = warc.get("X-Marks", "").split()
        url = None if "null-url" in marks else warc.get("WARC-Target-URI")
        host = host_of(url)
        if hosts is not None and host not in hosts:
            continue
        head, _, body = block.partition(b"\r\n\r\n") if not block.startswith(b"\r\n") else (b"", b"", block)
        start, *rest = head.decode("utf-8", "replace").split("\r\n")
        code = (start.split(" ") + [""])[1]
        day = date.fromisoformat(warc["WARC-Date"][:10]) if warc.get("WARC-Date") else None
        yield url, host, day, int(code) if code.isdigit() else None, None if "null-headers" in marks else _fields(rest), None if "null-body" in marks else body


@dataclass
class File(InputPartition):
    path: str
    hosts: frozenset | None


class Reader(DataSourceReader):
    def __init__(self, root: str, since: str | None = None, until: str | None = None, hosts: str | None = None):
        self.root = root
        self.since, self.until = (date.fromisoformat(x) if x else None for x in (since, until))
        self.hosts = None if hosts is None else frozenset(json.loads(hosts))

    def _wanted(self, day: date | None) -> bool:
        if day is None:
            return self.since is None and self.until is None
        return (self.since is None or day >= self.since) and (self.until is None or day <= self.until)

    def partitions(self):
        from pyarrow import fs

        system, root = _fs(self.root)
        buckets = None if self.hosts is None else {bucket_of(h) for h in self.hosts}
        files = []
        for d in sorted(x.path for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.type == fs.FileType.Directory):
            m = re.fullmatch(r"day=(.+)", posixpath.basename(d))
            if not m or not self._wanted(None if m[1] == NO_DAY else date.fromisoformat(m[1])):
                continue
            for x in sorted(system.get_file_info(fs.FileSelector(d, recursive=True)), key=lambda x: x.path):
                b = re.search(r"/bucket=(\d+)/[^/]+\.warc\.gz$", x.path)
                if b and (buckets is None or int(b[1]) in buckets):
                    files.append(File(x.path, self.hosts))
        return files or [File("", self.hosts)]  # Spark wants one at least

    def read(self, partition):
        if partition.path:
            system, _ = _fs(self.root)
            with system.open_input_stream(partition.path, compression=None) as raw, gzip.open(io.BufferedReader(_Raw(raw)), "rb") as stream:
                yield from records(stream, partition.hosts)


class _Raw(io.RawIOBase):
    """An input stream of pyarrow for Python's readers."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        got = self.stream.read(len(into))
        into[: len(got)] = got
        return len(got)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class Writer(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.job = root, overwrite, uuid.uuid4().hex

    def _aside(self, root: str) -> str:
        return f"{root}/_writing-{self.job}"

    def write(self, iterator):
        system, root = _fs(self.root)
        open_, files, name = {}, [], f"{uuid.uuid4().hex}.warc.gz"
        for row in iterator:
            day, bucket = row["day"], bucket_of(host_of(row["url"]))
            if (day, bucket) not in open_:
                to = f"day={day or NO_DAY}/bucket={bucket:02d}/{name}"
                aside = f"{self._aside(root)}/{to}"
                system.create_dir(posixpath.dirname(aside))
                open_[day, bucket] = system.open_output_stream(aside, compression=None)
                files.append((aside, f"{root}/{to}"))
            open_[day, bucket].write(record(row["url"], day, row["status"], row["headers"], row["body"]))
        for out in open_.values():
            out.close()
        return Written(files)

    def commit(self, messages):
        from pyarrow import fs

        system, root = _fs(self.root)
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if posixpath.basename(x.path).startswith("day="):
                    system.delete_dir(x.path)
        for m in messages:
            for aside, to in m.files if m else ():
                system.create_dir(posixpath.dirname(to))
                system.move(aside, to)
        self.abort(messages)

    def abort(self, messages):
        from pyarrow import fs

        system, root = _fs(self.root)
        if system.get_file_info(self._aside(root)).type == fs.FileType.Directory:
            system.delete_dir(self._aside(root))


class WarcSource(DataSource):
    """format("warc"): archived responses."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options["path"], *(self.options.get(x) for x in ("since", "until", "hosts")))

    def writer(self, schema, overwrite):
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make format("warc") known."""
    register_pickle_by_value(sys.modules[__name__])  # workers that plan a source need not have the library
    spark.dataSource.register(WarcSource)


def responses(spark: SparkSession, root: str, since: str | None = None, until: str | None = None, hosts: list[str] | None = None) -> DataFrame:
    """Archived responses from since to until, both included, of some hosts (lower-case; None: those without one)."""
    load = spark.read.format("warc")
    for name, value in (("since", since), ("until", until), ("hosts", None if hosts is None else json.dumps(hosts))):
        if value is not None:
            load = load.option(name, value)
    return load.load(root)

"""Web archives: a writer of per-record gzip members and a reader that salvages damaged files.

The reader checks every record (gzip's checksum, the header, the length, the block digest).  Where a check
fails it searches on for the next byte that begins a valid gzip member or version line, takes up reading
there, and logs the bytes between as quarantined.  Nothing but the bytes at fault is lost.

Tasks write and read the files through Arrow's file systems, at the folder's own address.  A file name
holds a fresh token, and only files that a finished task reports are ever read, so that repeated or lost
tasks leave no record twice.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpoint_dir, materialize

VERSION = b"WARC/1.1"
VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r?\n")
GZIP = b"\x1f\x8b\x08"
BREAK = b"\r\n"
CHUNK = 1 << 18
FILE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
LEAST_REVISIT = 100
URN = "urn:page:"


def _clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(ident: str, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: str | None, date: str = DATE) -> bytes:
    """A response with its payload, or, where ``refers_to`` is given, a revisit without one."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + (payload or b"")
    head = [
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <{URN}{ident}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {_clean(url)}"] if url else []),
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([f"WARC-Refers-To: <{URN}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to is not None else []),
        f"Content-Length: {len(block)}",
    ]
    return VERSION + BREAK + "\r\n".join(head).encode() + BREAK * 2 + block + BREAK * 2


def member(data: bytes) -> bytes:
    """One gzip member."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Record:
    """A record that passed all checks."""

    headers: dict[str, str]
    payload: bytes
    payload_length: int


class BadRecord(ValueError):
    """A check failed."""


def parse(data: bytes, at: int) -> tuple[Record, int]:
    """The record at a place of the data and the place after it."""
    line = VERSION_LINE.match(data, at)
    if not line:
        raise BadRecord("no version line")
    end = data.find(BREAK * 2, at)
    if end < 0:
        raise BadRecord("header does not end")
    headers = {}
    for x in data[line.end() : end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = x.partition(":")
        if not colon:
            raise BadRecord("bad header line")
        headers[name.strip().lower()] = value.strip()
    try:
        size = int(headers["content-length"])
    except (KeyError, ValueError):
        raise BadRecord("no length") from None
    start = end + 4
    block, tail = data[start : start + size], data[start + size : start + size + 4]
    if size < 0 or len(block) < size or tail != BREAK * 2:
        raise BadRecord("wrong length")
    kind, _, digest = headers.get("warc-block-digest", "").partition(":")
    if kind == "sha256" and hashlib.sha256(block).hexdigest() != digest.lower():
        raise BadRecord("wrong digest")
    payload, length = block, size
    if headers.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(BREAK * 2)
        told = re.search(rb"\r\ncontent-length:\s*(\d+)", head, re.I)
        length = int(told[1]) if told else len(payload)
    return Record(headers, payload, length), start + size + 4


class Salvage:
    """Records of one archive file and the byte ranges that had to be passed over."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size = file, file.size()
        self.gaps: list[tuple[int, int, str]] = []

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(min(n, self.size - at))

    def _member(self, at: int) -> tuple[bytes, int]:
        """The content of the gzip member at a place, and the place after it."""
        opener, out, place = zlib.decompressobj(31), [], at
        while not opener.eof:
            chunk = self._bytes(place, CHUNK)
            if not chunk:
                raise BadRecord("member does not end")
            try:
                out.append(opener.decompress(chunk))
            except zlib.error as e:
                raise BadRecord(f"member: {e}") from None
            place += len(chunk)
        return b"".join(out), place - len(opener.unused_data)

    def _plain(self, at: int) -> tuple[Record, int]:
        """The uncompressed record at a place of the file."""
        head, n = b"", CHUNK
        while BREAK * 2 not in head:
            head = self._bytes(at, n)
            if len(head) < n and BREAK * 2 not in head:
                raise BadRecord("header does not end")
            n *= 2
        told = re.search(rb"\r\ncontent-length:\s*(\d+)\s*\r\n", head[: head.index(BREAK * 2) + 2], re.I)
        if not told or at + int(told[1]) > self.size:
            raise BadRecord("no length" if not told else "wrong length")
        found, end = parse(self._bytes(at, head.index(BREAK * 2) + 8 + int(told[1])), 0)
        return found, at + end

    def _at(self, at: int) -> tuple[list[Record], int]:
        """All records of the member or version line at a place, and the place after them."""
        start = self._bytes(at, 16)
        if start.startswith(GZIP):
            data, end = self._member(at)
            found, place = [], 0
            while place < len(data):
                try:
                    one, place = parse(data, place)
                    found.append(one)
                except BadRecord as e:  # the member is whole, a record in it is not
                    self.gaps.append((at, end, str(e)))
                    later = VERSION_LINE.search(data, place + 1)
                    place = later.start() if later else len(data)
            return found, end
        if VERSION_LINE.match(start):
            one, end = self._plain(at)
            return [one], end
        raise BadRecord("neither a member nor a version line")

    def _next(self, at: int) -> int:
        """The next place from ``at`` on that may begin a record; the file's end if there is none."""
        while at < self.size:
            chunk = self._bytes(at, CHUNK + 16)
            places = [p for p in (chunk.find(GZIP), chunk.find(b"WARC/")) if p >= 0]
            if places:
                return at + min(places)
            if len(chunk) <= CHUNK:
                break
            at += CHUNK
        return self.size

    def __iter__(self) -> Iterator[tuple[int, Record]]:
        at, bad, why = 0, None, ""
        while at < self.size:
            try:
                found, end = self._at(at)
            except BadRecord as e:
                if bad is None:
                    bad, why = at, str(e)
                at = self._next(at + 1)
                continue
            if bad is not None:
                self.gaps.append((bad, at, why))
                bad = None
            for one in found:
                yield at, one
            at = end
        if bad is not None:
            self.gaps.append((bad, self.size, why))


def write(pages: DataFrame, folder: str, ident: str = "page_id", url: str = "url", body: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record per row to gzip archives in a folder; returns ``path, records, bytes`` of its files.

    The payload is the text in UTF-8, empty for a null.  Of rows with equal payloads of at least
    ``LEAST_REVISIT`` bytes those with the smallest ``ident`` are responses and the others revisit it.  A row
    with a null ``ident`` is a response.  Repeated rows give repeated records.
    """
    payload = F.coalesce(F.col(body).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(ident).cast("string").alias("id"), F.col(ident).alias("key"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    light = rows.where(f"key IS NOT NULL AND size >= {LEAST_REVISIT}").select("key", "digest")
    firsts = materialize(light.groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").select("digest", "first"))
    later = materialize(light.join(firsts, "digest").where("key > first").select("key", "digest", F.col("first").cast("string").alias("refers_to")).distinct())
    told = rows.join(later, ["key", "digest"], "left")
    told = told.select("id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "size", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        stem = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        stream, name, done, n, size = None, "", [], 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if stream is None:
                    name, n, size = f"{root}/{stem}-{len(done):04d}.warc.gz", 0, 0
                    stream = system.open_output_stream(name, compression=None)
                data = member(record(row["id"] or "", row["url"], row["payload"], row["size"], row["digest"], row["refers_to"]))
                stream.write(data)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    stream.close()
                    done.append((name, n, size))
                    stream = None
        if stream is not None:
            stream.close()
            done.append((name, n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "records", "bytes"])

    return materialize(told.mapInArrow(run, "path string, records long, bytes long"))


def read(files: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """Rows of the archives named in ``files.path``: records and, between them, quarantined gaps.

    ``path, start, stop, error`` place a row in its file (``error`` says why a gap was passed over and is
    null for a record); ``record_id, record_type, refers_to, target_uri, payload_length, payload_digest`` and,
    if asked for, ``payload`` describe a record.  The digest of a payload that is there is computed, that of a
    revisit is the one it states.  An empty file has no rows.
    """
    names = ["path", "start", "stop", "error", "record_id", "record_type", "refers_to", "target_uri", "payload_length", "payload_digest", *(["payload"] if payload else [])]
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), *([pa.binary()] if payload else [])]
    schema = "path string, start long, stop long, error string, record_id string, record_type string, refers_to string, target_uri string, payload_length long, payload_digest string" + (", payload binary" if payload else "")

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = fs.FileSystem.from_uri(folder)[0] if "://" in folder or folder.startswith("file:") else fs.LocalFileSystem()
        bare = lambda x: x.removeprefix("<").removesuffix(">").removeprefix(URN) if x is not None else None
        for paths in batches:
            for path in paths.column(0).to_pylist():
                with system.open_input_file(path) as file:
                    salvage, rows, held = Salvage(file), [], 0
                    for at, one in salvage:
                        h = one.headers
                        revisit = h.get("warc-type") == "revisit"
                        digest = h.get("warc-payload-digest", "").partition(":")[2] if revisit else hashlib.sha256(one.payload).hexdigest()
                        rows.append((path, at, None, None, bare(h.get("warc-record-id")), h.get("warc-type"), bare(h.get("warc-refers-to")), h.get("warc-target-uri"), one.payload_length, digest, *([one.payload] if payload else [])))
                        held += len(one.payload) if payload else 0
                        if len(rows) >= 5_000 or held > CHUNK * 32:
                            yield batch(rows)
                            rows, held = [], 0
                    rows += [(path, a, b, why, *[None] * (len(names) - 4)) for a, b, why in salvage.gaps]
                    if rows:
                        yield batch(rows)

    # a task for each file; dealt by a column, a few paths would be put together in one
    paths = files.select(F.col("path").cast("string")).repartition(max(1, files.count()))
    return paths.mapInArrow(run, schema)


def archive_folder(spark) -> str:
    """A fresh folder for archives in the session's shared folder."""
    return f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"

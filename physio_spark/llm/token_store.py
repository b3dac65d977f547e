"""Token ids of a corpus in files that can be searched: one wavelet matrix per shard.

Documents are range-partitioned and sorted by key; every task tokenises its stretch and writes shards of
bounded size.  A shard is one file: a header (sizes and the place and checksum of each section), the keys and
ends of its documents, and for each bit-plane the bits and the directory that rank and select read.
Sections are compressed one by one and read when they are needed, so a lookup opens no other file.

A file name holds a fresh token, and only files that a finished task reports are ever read, so that repeated
or lost tasks leave no document twice.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import checkpoint_dir, materialize
from .common import Shared, refuse, slices
from .token_ids import WordIds
from .wavelet import Plane, WaveletMatrix

MAGIC = b"WVLTOK01"
END = 1
# Text of one partition, tokens of one shard (a longer document is a shard of its own), bytes of one answer.
PART_BYTES = 32 << 20
SHARD_TOKENS = 8 << 20
BLOCK_BYTES = 8 << 20
ANSWER_BYTES = 4 << 20
CODEC = "zstd"


class DamagedShard(ValueError):
    """A file is cut off or one of its sections fails its checksum."""


def shard_bytes(keys: pa.Array, lengths: np.ndarray, ids: np.ndarray, width: int) -> Iterator[bytes]:
    """The parts of a shard's file, in order."""
    matrix = WaveletMatrix.of(ids, width)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("key", keys.type)])) as out:
        out.write_batch(pa.record_batch([keys], ["key"]))
    raw = [("keys", sink.getvalue().to_pybytes()), ("lengths", lengths.astype("<u8").tobytes())]
    for i, plane in enumerate(matrix.planes):
        raw += [(f"bits{i}", plane.words.tobytes()), (f"ones{i}", np.diff(plane.before, prepend=0).astype("<u2").tobytes())]
    codec, sections, bodies, at = pa.Codec(CODEC), [], [], 0
    for name, data in raw:
        packed = codec.compress(data, asbytes=True)
        packed = packed if len(packed) < len(data) else data
        sections.append([name, at, len(packed), len(data), zlib.crc32(packed)])
        bodies.append(packed)
        at += len(packed)
    head = {"tokens": len(ids), "documents": len(lengths), "width": width, "zeros": [p.zeros for p in matrix.planes], "codec": CODEC, "sections": sections}
    text = json.dumps(head).encode()
    yield MAGIC + struct.pack("<II", len(text), zlib.crc32(text)) + text
    yield from bodies


class TokenShard:
    """One shard, read section by section from an open file."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file = file
        start = self._bytes(0, 16)
        if start[:8] != MAGIC:
            raise DamagedShard("not a token shard")
        size, check = struct.unpack("<II", start[8:])
        text = self._bytes(16, size)
        if zlib.crc32(text) != check:
            raise DamagedShard("header")
        head = json.loads(text)
        self.tokens, self.documents, self.width = head["tokens"], head["documents"], head["width"]
        self._zeros, self._codec, self._first = head["zeros"], pa.Codec(head["codec"]), 16 + size
        self._sections = {name: rest for name, *rest in head["sections"]}
        self._keys: pa.Array | None = None
        self._ends: np.ndarray | None = None
        self._matrix: WaveletMatrix | None = None

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) < n:
            raise DamagedShard("the file is cut off")
        return data

    def _section(self, name: str) -> bytes:
        at, size, whole, check = self._sections[name]
        data = self._bytes(self._first + at, size)
        if zlib.crc32(data) != check:
            raise DamagedShard(name)
        return data if size == whole else self._codec.decompress(data, whole, asbytes=True)

    @property
    def keys(self) -> pa.Array:
        """The key of each document, in order."""
        if self._keys is None:
            self._keys = pa.ipc.open_stream(self._section("keys")).read_all().column(0).combine_chunks()
        return self._keys

    @property
    def ends(self) -> np.ndarray:
        """Where each document ends among the shard's tokens."""
        if self._ends is None:
            self._ends = np.cumsum(np.frombuffer(self._section("lengths"), "<u8").astype(np.int64))
        return self._ends

    @property
    def matrix(self) -> WaveletMatrix:
        if self._matrix is None:
            planes = []
            for i, zeros in enumerate(self._zeros):
                ones = np.frombuffer(self._section(f"ones{i}"), "<u2")
                planes.append(Plane(np.frombuffer(self._section(f"bits{i}"), "<u8").reshape(-1, 8), np.cumsum(ones, dtype=np.int64), zeros))
            self._matrix = WaveletMatrix(self.tokens, planes)
        return self._matrix

    def document(self, nth: int) -> np.ndarray:
        """The ids of one document, its end id included."""
        lo = int(self.ends[nth - 1]) if nth else 0
        return self.matrix.access(np.arange(lo, int(self.ends[nth])))

    def where(self, token: int) -> tuple[np.ndarray, np.ndarray]:
        """Every occurrence of a token: the document's number in the shard and the place in the document."""
        places = self.matrix.find(token)
        owner = np.searchsorted(self.ends, places, "right")
        return owner, places - np.concatenate([[0], self.ends])[owner]


def token_folder(spark: SparkSession) -> str:
    """A fresh folder for shards in the session's shared folder."""
    return f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write(docs: DataFrame, tokenizer: str, folder: str, key: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """Write the ids of every row, each row's followed by ``end``, in ascending order of ``key``.

    Returns one row per file: ``part, seq`` (files stand in this order), ``path, documents, tokens, bytes,
    first`` (tokens of all files before it).  A null text is an empty one: its end id alone.  Null keys come
    first; rows of one key stand together, in the order of a hash of their text; repeated rows are written as
    often as they stand in the table.  An empty table has no files.  Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t"))
    total = rows.agg(F.sum(F.octet_length("t").cast("long") + 8)).first()[0] or 0
    order = [F.col("key").asc_nulls_first(), F.xxhash64("t")]
    dealt = rows.repartitionByRange(-(-total // PART_BYTES) or 1, *order).sortWithinPartitions(*order)
    shared = Shared(spark, tokenizer, WordIds)
    names = ["part", "seq", "path", "documents", "tokens", "bytes"]
    schema = "part int, seq int, path string, documents long, tokens long, bytes long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.get()
        width = max(max(words.tokenizer.get_vocab().values()), end, 1).bit_length()
        kind = np.uint16 if width <= 16 else np.uint32
        system, root = _place(folder)
        system.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        stem = f"{root}/part-{part:06d}-{uuid.uuid4().hex}"
        keys: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        done: list[tuple] = []

        def flush() -> None:
            own, size = np.concatenate(ids), np.concatenate(lengths)
            name, n = f"{stem}-{len(done):05d}.wvt", 0
            with system.open_output_stream(name, compression=None) as stream:
                for data in shard_bytes(pa.concat_arrays(keys), size, own, width):
                    stream.write(data)
                    n += len(data)
            done.append((part, len(done), name, len(size), len(own), n))
            for held in (keys, lengths, ids):
                held.clear()

        for batch in batches:
            for lo, hi in slices(batch.column(1), BLOCK_BYTES):
                found, ends = words.flat_ids(batch.column(1)[lo:hi])
                size = np.diff(ends, prepend=0) + 1
                whole = np.full(len(found) + len(size), end, kind)
                inner = np.ones(len(whole), bool)
                inner[np.cumsum(size) - 1] = False
                whole[inner] = found
                keys.append(batch.column(0)[lo:hi])
                lengths.append(size)
                ids.append(whole)
                if sum(map(len, ids)) >= SHARD_TOKENS:
                    flush()
        if ids:
            flush()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 3], strict=True)], names)

    files = materialize(dealt.mapInArrow(run, schema))
    # one row for each file: the window orders file sizes, never tokens
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return materialize(files.withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long")))


def _over_shards(files: DataFrame, folder: str, schema: str, answer: Callable[[TokenShard, int], Iterator[pa.RecordBatch]]) -> DataFrame:
    """One task per file, each answering from its shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _place(folder)
        for batch in batches:
            for path, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with system.open_input_file(path) as file:
                    yield from answer(TokenShard(file), first)

    return files.select("path", "first").repartition(max(1, files.count())).mapInArrow(run, schema)


def read(files: DataFrame, folder: str, key: str = "doc_id", kind: str = "long") -> DataFrame:
    """``key, start, n_tokens, ids`` of every document: tokens before it in all files, its ids as unsigned 32-bit numbers.

    ``kind`` is the type of the keys that were written.
    """
    refuse(key, "start", "n_tokens", "ids")

    def answer(shard: TokenShard, first: int) -> Iterator[pa.RecordBatch]:
        ids, ends = shard.matrix.decode(np.uint32).astype("<u4", copy=False), shard.ends
        starts = np.concatenate([[0], ends[:-1]])
        lo = 0
        while lo < len(ends):
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + ANSWER_BYTES // 4, "right")))
            own = ids[starts[lo] : ends[hi - 1]]
            offsets = np.concatenate([[0], ends[lo:hi] - starts[lo]]).astype(np.int32) * 4
            body = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(offsets), pa.py_buffer(own.tobytes())])
            yield pa.RecordBatch.from_arrays([shard.keys[lo:hi], pa.array(first + starts[lo:hi]), pa.array(ends[lo:hi] - starts[lo:hi]), body], ["key", "start", "n_tokens", "ids"])
            lo = hi

    return _over_shards(files, folder, f"key {kind}, start long, n_tokens long, ids binary", answer).withColumnRenamed("key", key)


def counts(files: DataFrame, folder: str, tokens: Sequence[int]) -> DataFrame:
    """``token, n`` of each token asked for over all shards, by rank alone; no id is decoded."""
    wanted = sorted(set(tokens))

    def answer(shard: TokenShard, first: int) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array([shard.matrix.count(t) for t in wanted], pa.int64())], ["token", "n"])

    return _over_shards(files, folder, "token long, n long", answer).groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(files: DataFrame, folder: str, tokens: Sequence[int], key: str = "doc_id", kind: str = "long") -> DataFrame:
    """``token, key, place``: every place of each token asked for (from 0 in its document), by select."""
    wanted = sorted(set(tokens))

    def answer(shard: TokenShard, first: int) -> Iterator[pa.RecordBatch]:
        for token in wanted:
            owner, place = shard.where(token)
            for lo in range(0, len(owner), 100_000):
                own, at = owner[lo : lo + 100_000], place[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), token)), shard.keys.take(pa.array(own)), pa.array(at)], ["token", "key", "place"])

    return _over_shards(files, folder, f"token long, key {kind}, place long", answer).withColumnRenamed("key", key)

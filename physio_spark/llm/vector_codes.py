"""Short codes for vectors: one nearest codebook entry for each part, learned and assigned in exact integers.

Components become integers, and every vector is cut into equal parts.  Distances come from dot products, which
are matrix products of limbs: each integer is split into limbs of 12 bits, so that a float64 product over a part
stays below 2^53 and is exact, whatever order BLAS adds in; the products are put together again in int64.  The
first smallest distance wins.  So the result is the same on every machine and under every partitioning.

Each round is one pass: tasks return the sums and counts of their own entries, and the driver sees one row for each
entry.  Rows whose vector is null, holds a null or non-finite component or has another length than most vectors
(on a tie the longer) take no part; vectors whose length the parts do not divide are filled up with zeros.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import attach
from ..runtime import materialize
from .common import Shared, refuse

LIMB = 12
# 2^(2 * LIMB) times the longest part, or the rows of one block, stays below 2^53.
LONGEST = 1 << 53 - 2 * LIMB - 1
BLOCK_ROWS = 1 << 14


def limbs(values: np.ndarray, most: int) -> np.ndarray:
    """Stacked limbs, lowest first, of integers of at most ``most`` in magnitude; all but the last are in [0, 2^12)."""
    n = max(1, math.ceil((int(most).bit_length() + 1) / LIMB))
    low = (1 << LIMB) - 1
    return np.stack([(values >> LIMB * i if i == n - 1 else values >> LIMB * i & low) for i in range(n)]).astype(np.float64)


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact int64 products of limbed stacks of matrices (limb, part, rows, width) and (limb, part, width, columns)."""
    out = 0
    for i in range(len(a)):
        for j in range(len(b)):
            out = out + (np.matmul(a[i], b[j]).astype(np.int64) << LIMB * (i + j))
    return out


@dataclass
class Codebooks:
    """``entries[part, entry, position]`` with all that is needed to encode: sizes, scale and the largest magnitude."""

    entries: np.ndarray
    dims: int
    scale: int
    most: int

    @property
    def parts(self) -> int:
        return self.entries.shape[0]

    def sha256(self) -> str:
        """Digest of all entries as decimal numbers by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, codes: list[str]) -> np.ndarray:
        """The vectors that codes stand for."""
        at = np.array([list(bytes.fromhex(c)) for c in codes], np.int64).reshape(len(codes), self.parts)
        return self.entries[np.arange(self.parts), at].reshape(len(codes), -1)[:, : self.dims] / self.scale


def _integers(column: pa.Array, dims: int, parts: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of rows that take part: their numbers and their integers by part, row and position."""
    width = -(-dims // parts)
    for lo in range(0, len(column), BLOCK_ROWS):
        some = column[lo : lo + BLOCK_ROWS]
        fit = pc.fill_null(pc.equal(pc.list_value_length(some), dims), False)
        rows = np.flatnonzero(fit.to_numpy(zero_copy_only=False))
        values = pc.fill_null(some.filter(fit).flatten().cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False)
        values = values.reshape(len(rows), dims)
        good = np.isfinite(values).all(1)
        whole = np.zeros((int(good.sum()), parts * width), np.int64)
        whole[:, :dims] = np.floor(values[good] * scale)
        if len(whole):
            yield lo + rows[good], np.ascontiguousarray(whole.reshape(len(whole), parts, width).transpose(1, 0, 2))


def _nearest(values: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each part and row the first nearest entry and its squared distance, and the limbs of the values."""
    split = limbs(values, books.most)
    cross = dot(split, limbs(books.entries.transpose(0, 2, 1), books.most))
    away = (values * values).sum(2)[:, :, None] - 2 * cross + (books.entries * books.entries).sum(2)[:, None, :]
    best = away.argmin(2)
    return best, np.take_along_axis(away, best[:, :, None], 2)[:, :, 0], split


def _kept(df: DataFrame, vector: Column) -> DataFrame:
    """Rows of vectors without null or non-finite components."""
    finite = (F.array_max(vector) < math.inf) & (F.array_min(vector) > -math.inf) & ~F.exists(vector, F.isnull)
    return df.where(vector.isNotNull()).where(F.coalesce(finite, F.size(vector) == 0))


def fit(df: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks:
    """Codebooks that begin as the vectors of the smallest keys (null keys last) and move for some rounds.

    A round assigns every part to its nearest entry (squared Euclidean distance, ties to the lower index) and
    moves each entry to the componentwise floored mean of its parts; unused entries stay.  Of rows with one key
    the smaller vector comes first.  Where there are fewer vectors than entries there are fewer entries, and none
    over an empty table.  Distances that do not fit 64 bits are refused.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    v = F.col(vector)
    kept = _kept(df.select(F.col(key).alias("key"), v.alias("v")), F.col("v"))
    top = F.max(F.greatest(F.abs(F.array_max("v").cast("double")), F.abs(F.array_min("v").cast("double"))))
    most_common = kept.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n"), top.alias("top"))
    told = most_common.orderBy(F.desc("n"), F.desc("dims")).first()
    if told is None:
        return Codebooks(np.zeros((parts, 0, 0), np.int64), 0, scale, 0)
    dims, width = told["dims"], -(-told["dims"] // parts)
    most = math.floor((told["top"] or 0.0) * scale) + 1
    if max(width, 1) * (2 * most) ** 2 >= 1 << 63:
        raise OverflowError(f"squared distances of components up to {most} do not fit 64 bits")
    if width > LONGEST:
        raise OverflowError(f"parts of {width} components: products of limbs would not be exact")
    first = kept.where(F.size("v") == dims).orderBy(F.col("key").asc_nulls_last(), "v").limit(entries)
    start = first.select("v").toPandas()["v"].tolist()  # at most one row for each entry
    whole = np.zeros((len(start), parts * width), np.int64)
    whole[:, :dims] = np.floor(np.array([np.asarray(x, np.float64) for x in start]).reshape(len(start), dims) * scale)
    books = Codebooks(np.ascontiguousarray(whole.reshape(len(start), parts, width).transpose(1, 0, 2)), dims, scale, most)
    for _ in range(rounds):
        books = _moved(df, vector, books)
    return books


def _moved(df: DataFrame, vector: str, books: Codebooks) -> Codebooks:
    """The codebooks after one round."""
    parts, size, width = books.entries.shape
    shared = Shared(df.sparkSession, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.get()
        total, n = np.zeros((parts, size, width), np.int64), np.zeros((parts, size), np.int64)
        for batch in batches:
            for _, values in _integers(batch.column(0), now.dims, parts, now.scale):
                best, _, split = _nearest(values, now)
                own = (best[:, None, :] == np.arange(size)[:, None]).astype(np.float64)
                total += dot(own[None], split)
                n += own.sum(2).astype(np.int64)
        used = np.flatnonzero(n.ravel())
        sums = pa.ListArray.from_arrays(np.arange(len(used) + 1, dtype=np.int32) * width, total.reshape(parts * size, width)[used].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n.ravel()[used]), sums], ["slot", "n", "sums"])

    told = df.select(vector).mapInArrow(run, "slot long, n long, sums array<long>")
    sums = F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]) if width else F.array().cast("array<long>")
    entries = books.entries.copy().reshape(parts * size, width)
    for slot, n, total in told.groupBy("slot").agg(F.sum("n").alias("n"), sums.alias("sums")).collect():  # a row for each entry
        entries[slot] = [x // n for x in total]
    return Codebooks(entries.reshape(parts, size, width), books.dims, books.scale, books.most)


def encode(df: DataFrame, books: Codebooks, key: str = "vec_id", vector: str = "embedding", label: str | None = "label") -> DataFrame:
    """``key``, the label if there is one, ``code`` (two hex digits for each part) and ``error`` of rows that take part.

    ``error`` is the squared distance between the integers and the entries, summed over the parts.  Repeated
    rows stay, other columns are not read.
    """
    for c in (key, label or ""):
        refuse(c, "code", "error", "label_error")
    shared = Shared(df.sparkSession, books)
    digits = np.array([b"%02x" % i for i in range(256)])
    rows = df.select(F.col(key).alias("key"), (F.col(label) if label else F.lit(None).cast("int")).alias("label"), F.col(vector).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.get()
        if not now.entries.size and now.entries.shape[1] == 0:
            return
        for batch in batches:
            for at, values in _integers(batch.column(2), now.dims, now.parts, now.scale):
                best, away, _ = _nearest(values, now)
                text = digits[best.T].tobytes()
                code = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(np.arange(len(at) + 1, dtype=np.int32) * 2 * now.parts), pa.py_buffer(text)])
                own = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), code, pa.array(away.sum(0))], ["key", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = rows.mapInArrow(run, f"key {kinds['key']}, label {kinds['label']}, code string, error long")
    return out.withColumnsRenamed({"key": key, "label": label}) if label else out.drop("label").withColumnRenamed("key", key)


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """Coded rows with ``label_error``: the errors of all rows of one label, nulls together."""
    coded = materialize(coded)
    return attach(coded, coded.groupBy(label).agg(F.sum("error").alias("label_error")), [label], salts=32)

"""Line deduplication behind two Bloom filters.

One pass over the texts fills a filter of keys seen once and a filter of keys seen twice; a second pass
asks only the latter.  Keys that it does not hold are unique and never leave their task.  Suspects are
shuffled with their whole text, confirmed exactly, and their first document is chosen.  A filter that
is too small for the corpus costs shuffling, never a wrong result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from . import bloom
from .common import SPACE, Shared, fresh, refuse, texts, widened, without

LEAST_KEY = 10
FLUSH = 1 << 20


def line_key(line: bytes) -> bytes:
    """The line stripped of [\\x20\\x09-\\x0D] at both ends, A-Z in lower case."""
    return line.strip(SPACE).lower()


def _long_enough(key: bytes) -> bool:
    return len(key) >= LEAST_KEY and (len(key) >= 4 * LEAST_KEY or len(key.decode("utf-8", "surrogatepass")) >= LEAST_KEY)


def document_keys(text: bytes) -> set[bytes]:
    """The distinct keys of a text that are long enough to be judged."""
    return {k for k in set(map(line_key, text.split(b"\n"))) if _long_enough(k)}


def seen_twice(docs: DataFrame, text: str, segments: int) -> bytes:
    """The filter of keys seen in two rows or more."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[int] = []

        def flush() -> pa.RecordBatch:
            columns = zip(*bloom.filled(np.array(found, np.uint64), segments), strict=True)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["segment", "part", "once", "twice"])

        for batch in batches:
            for body in texts(batch.column(0)):
                found.extend(map(xxhash.xxh3_64_intdigest, document_keys(body)))
                if len(found) >= FLUSH:
                    yield flush()
        if found:
            yield flush()

    rows = docs.select(F.col(text).cast("string")).mapInArrow(fill, "segment long, part long, once binary, twice binary")
    return bloom.seen_twice(rows, segments)


def suspects(docs: DataFrame, key: str, text: str, filter_bytes: bytes) -> DataFrame:
    """``doc, line, mark``: keys that may be in two rows, with a 128-bit mark of each."""
    shared = Shared(docs.sparkSession, filter_bytes)
    rows = docs.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("t")).where("doc IS NOT NULL")
    kind = rows.schema["doc"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.get(), np.uint8)
        for batch in batches:
            owner, keys = [], []
            for row, body in enumerate(texts(batch.column(1))):
                own = document_keys(body)
                owner.extend([row] * len(own))
                keys.extend(own)
            hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
            hit = np.flatnonzero(bloom.holds(bits, hashes))
            lines = [keys[k] for k in hit.tolist()]
            docs_of = batch.column(0).take(pa.array(np.array(owner, np.int64)[hit]))
            yield pa.RecordBatch.from_arrays([docs_of, pa.array(lines, pa.binary()), pa.array([xxhash.xxh3_128_digest(k) for k in lines], pa.binary())], ["doc", "line", "mark"])

    return rows.mapInArrow(run, f"doc {kind.simpleString()}, line binary, mark binary")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", segments: int = 1024, counts: tuple[str, str] | None = ("n_lines", "n_dropped")) -> DataFrame:
    """All columns of the rows, ``text`` without the lines that a smaller document holds too.

    Lines are split at ``\\n``; a null or empty text is one empty line and comes back empty.  A key of at
    least ten code points that is found under two values of ``key`` or more stays in the smallest one,
    all its lines there included.  Rows with a null ``key`` come back as they are and are no document.
    Rows that repeat a ``key`` are one document.  ``counts`` names columns for the number of lines before
    and of lines dropped, which take the place of columns of these names; None leaves them out.  ``segments`` (a power of two) bounds each filter to
    ``segments`` times 8 KiB; a larger one shuffles fewer suspects in a larger corpus.
    """
    if segments & segments - 1:
        raise ValueError("segments must be a power of two")
    for c in (key, text):
        refuse(c, *(counts or ()))
    docs = without(docs, *(counts or ()))
    held = materialize(suspects(docs, key, text, seen_twice(docs, text, segments)))
    repeated = held.groupBy("line").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.first("mark").alias("mark"))
    firsts = materialize(repeated.where("first < last").select("mark", "first"))
    later = held.select("doc", "mark").join(firsts, "mark").where("doc > first")
    dropped, owner = fresh(docs.columns, "drop"), fresh(docs.columns, "owner")
    lists = later.groupBy(F.col("doc").alias(owner)).agg(F.collect_set("mark").alias(dropped))
    joined = docs.join(lists, docs[key] == F.col(owner), "left").drop(owner)
    out_schema = widened(docs.schema, **dict.fromkeys(counts or (), "long"))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n, gone = [], [], []
            drops = batch.column(batch.num_columns - 1)
            for body, drop in zip(texts(batch.column(place)), drops, strict=True):
                lines = body.split(b"\n")
                n.append(len(lines))
                if drop.is_valid:
                    marks = {x.as_py() for x in drop.values}
                    lines = [x for x in lines if xxhash.xxh3_128_digest(line_key(x)) not in marks]
                gone.append(n[-1] - len(lines))
                kept.append(b"\n".join(lines) if gone[-1] else body)
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(n), pa.array(gone)] if counts else [])], names)

    names = out_schema.fieldNames()
    return joined.mapInArrow(run, out_schema)

"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import prepare

# Bytes that separate words and that line keys are stripped of: [\x20\x09-\x0D].
SPACE = b" \t\n\x0b\x0c\r"

# Compressed bytes of a shuffle that a task is given: with 64 MB, sorts of whole texts filled an executor's heap.
TASK_BYTES = "16m"


def session(spark: SparkSession) -> SparkSession:
    """The session with the options that operators on long texts rely on: batches to Python are bounded in bytes."""
    prepare(spark, TASK_BYTES).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: Column, n: int) -> Column:
    """crc32 of a key's text modulo n; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % n


def unit(key: Column) -> Column:
    """A fixed number in [0, 1) for each key, for bounded samples that every retry draws alike."""
    return F.pmod(F.xxhash64(key.cast("string"), F.lit("sample")), F.lit(1_000_003)) / F.lit(1_000_003.0)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets, without a Python object per row; nulls are empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not pa.types.is_large_string(array.type):
        array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if offsets else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """The UTF-8 of each row, nulls as empty."""
    data, at = utf8(column)
    raw = data.tobytes()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield raw[a:b]



def slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``most`` bytes of text each; a longer text is one of its own."""
    ends = utf8(column)[1]
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a string column: the distinct ones, their numbers end to end, and each row's end.

    Nulls have no words.  Splitting and numbering run in Arrow, without a Python object per word.
    """
    split = pc.ascii_split_whitespace(column.fill_null("") if column.null_count else column)
    coded = split.flatten().dictionary_encode()
    numbers = coded.indices.to_numpy().astype(np.int64)
    ends = np.cumsum(pc.list_value_length(split).to_numpy().astype(np.int64))
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()  # white space at a text's ends
    if empty >= 0:
        keep = numbers != empty
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        numbers = numbers[keep]
    return coded.dictionary, numbers, ends


class Shared:
    """A broadcast value of which every Python worker builds its own object once, and keeps the newest."""

    _built: dict[str, object] = {}

    def __init__(self, spark: SparkSession, value: object, build: Callable[[object], object] | None = None) -> None:
        self.token, self.build = uuid.uuid4().hex, build
        self.broadcast = spark.sparkContext.broadcast(value)

    def get(self):
        if self.build is None:
            return self.broadcast.value
        if self.token not in Shared._built:
            Shared._built.clear()
            pa.default_memory_pool().release_unused()
            Shared._built[self.token] = self.build(self.broadcast.value)
        return Shared._built[self.token]


def widened(schema: T.StructType, **columns: str) -> T.StructType:
    """A copy of a schema with more columns at its end."""
    out = T.StructType(list(schema.fields))
    for name, kind in columns.items():
        out = out.add(name, kind)
    return out


def refuse(column: str, *names: str) -> None:
    """Complain about a key or text column that has the name of a result column."""
    if column.lower() in {n.lower() for n in names}:
        raise ValueError(f"the result has a column {column!r} of its own")


def without(df: DataFrame, *names: str) -> DataFrame:
    """The frame without the columns whose names the result gives to its own."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def fresh(taken: list[str], name: str) -> str:
    """A column name that a frame does not use yet."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name

"""Bloom filters of hashes seen once and seen twice, filled by tasks and merged in levels.

A filter is cut into segments of 64 Ki bits by a hash's top bits; other bits of the hash are its probes.
A task sends the segments that it touched.  Two of them merge into once = a | b and
twice = a2 | b2 | (a & b), in any order.  The number of segments bounds a filter's size whatever the data;
one that is too small has more false suspects, and never misses a repeat.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

SEGMENT_BITS = 16
SEGMENT_BYTES = 1 << SEGMENT_BITS - 3
PROBES = 3
MERGED_AT_ONCE = 64


def _bits(hashes: np.ndarray) -> np.ndarray:
    """Bit numbers in a segment, one row for each probe."""
    return np.stack([(hashes >> np.uint64(SEGMENT_BITS * k)) & np.uint64((1 << SEGMENT_BITS) - 1) for k in range(PROBES)]).astype(np.int64)


def _segment(hashes: np.ndarray, segments: int) -> np.ndarray:
    return (hashes >> np.uint64(63 - (segments.bit_length() - 1))).astype(np.int64) >> 1


def _pack(hashes: np.ndarray) -> bytes:
    flags = np.zeros(1 << SEGMENT_BITS, bool)
    flags[_bits(hashes)] = True
    return zlib.compress(np.packbits(flags).tobytes(), 1)


def _open(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def filled(hashes: np.ndarray, segments: int) -> list[tuple[int, int, bytes, bytes]]:
    """(segment, part, once, twice) of a task's hashes; one that is listed again counts as seen twice."""
    part = TaskContext.get().partitionId() // MERGED_AT_ONCE
    distinct, n = np.unique(hashes, return_counts=True)
    ids, first = np.unique(_segment(distinct, segments), return_index=True)
    cut = np.append(first, len(distinct))
    return [(int(k), part, _pack(distinct[a:b]), _pack(distinct[a:b][n[a:b] > 1])) for k, a, b in zip(ids, cut[:-1], cut[1:], strict=True)]


def _merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    once, twice = (np.zeros(SEGMENT_BYTES, np.uint8) for _ in range(2))
    for a, b in zip(frame["once"], frame["twice"], strict=True):
        more = _open(a)
        twice = twice | _open(b) | (once & more)
        once = once | more
    return pd.DataFrame({"segment": [key[0]], "once": [zlib.compress(once.tobytes(), 1)], "twice": [zlib.compress(twice.tobytes(), 1)]})


def seen_twice(rows: DataFrame, segments: int) -> bytes:
    """The filter of hashes seen twice, of rows ``segment, part, once, twice``: ``segments`` times 8 KiB."""
    schema = "segment long, once binary, twice binary"
    parts = rows.groupBy("segment", "part").applyInPandas(_merge, schema)
    whole = bytearray(segments * SEGMENT_BYTES)
    for row in parts.groupBy("segment").applyInPandas(_merge, schema).select("segment", "twice").toLocalIterator():
        whole[row["segment"] * SEGMENT_BYTES : (row["segment"] + 1) * SEGMENT_BYTES] = _open(bytes(row["twice"])).tobytes()
    return bytes(whole)


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether a filter (as bytes of bits) may hold each hash."""
    at = (_segment(hashes, len(bits) // SEGMENT_BYTES) << SEGMENT_BITS) + _bits(hashes)
    return (bits[at >> 3] >> (7 - (at & 7)) & 1).all(0)

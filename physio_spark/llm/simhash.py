"""SimHash near-duplicates by a range join of segment bit counts.

A fingerprint maps to the numbers of set bits in its four 16-bit segments.  Flipping a bit moves this
point by one step, so the Manhattan distance of two points is a lower bound of the Hamming distance of
their fingerprints.  Points are cells of an integer grid; the fingerprints of a cell meet those of the
cells within reach, and only these pairs are compared bit by bit.

Equal fingerprints are one row from the start.  A full cell is cut into blocks; a pair of blocks answers
with a spanning forest of its links, never with the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .common import refuse, texts
from .components import components

SEGMENTS = 4
WIDTH = 64 // SEGMENTS
BLOCK = 2048


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-shingle]]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    total = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[lo : lo + (1 << 16)], ">u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """``key, fp`` of every row; fp is the fingerprint as a signed long.  A null text has no words."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle, seed) for t in texts(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["key", "fp"])

    out = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, fp long")
    return out.withColumnRenamed("key", key)


def _counts() -> list[Column]:
    mask = (1 << WIDTH) - 1
    return [F.bit_count(F.shiftrightunsigned("fp", WIDTH * k).bitwiseAND(F.lit(mask))).cast("long") for k in range(SEGMENTS)]


def _cell(counts: list[Column]) -> Column:
    """One number for a grid point; the base leaves room for points outside, which no fingerprint has."""
    out = F.lit(0).cast("long")
    for c in counts:
        out = out * 64 + c
    return out


def _steps(reach: int) -> list[int]:
    """Differences of cell numbers within reach, one of each opposite pair, and 0."""
    out = []
    for step in product(range(-reach, reach + 1), repeat=SEGMENTS):
        if sum(map(abs, step)) <= reach and step >= (0,) * SEGMENTS:
            number = 0
            for s in step:
                number = number * 64 + s
            out.append(number)
    return out


def _forest(a: np.ndarray, b: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of two blocks within reach as (fingerprint, smallest fingerprint that it hangs together with)."""
    near, far = [], []
    for lo in range(0, len(a), 256):
        i, j = np.nonzero(np.bitwise_count(a[lo : lo + 256, None] ^ b[None, :]) <= reach)
        own = a[lo + i] != b[j]
        near.append(a[lo + i[own]])
        far.append(b[j[own]])
    nodes, where = np.unique(np.concatenate(near + far).view(np.int64), return_inverse=True)
    if not len(nodes):
        return nodes, nodes
    left, right = where[: len(where) // 2], where[len(where) // 2 :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, left, label[right])
        np.minimum.at(new, right, label[left])
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def links(distinct: DataFrame, reach: int) -> DataFrame:
    """Edges ``a, b`` that connect every two of the distinct fingerprints within ``reach`` bits.

    At most 17**4 cells exist, so their sizes are a table of bounded size.
    """
    placed = distinct.select("fp", _cell(_counts()).alias("cell"))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"))
    cut = F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / BLOCK))
    blocks = materialize(placed.join(F.broadcast(sizes), "cell").groupBy("cell", cut.alias("cut")).agg(F.collect_list("fp").alias("fps")))
    other = blocks.select(F.col("cell").alias("to"), F.col("cut").alias("cut_b"), F.col("fps").alias("fps_b"))
    reached = F.explode(F.array(*[F.lit(x).cast("long") for x in _steps(reach)]))
    sent = blocks.select("*", reached.alias("step")).withColumn("to", F.col("cell") + F.col("step"))
    sent = sent.join(F.broadcast(sizes.select(F.col("cell").alias("to"))), "to", "left_semi")
    pairs = sent.join(other, "to").where("step <> 0 or cut <= cut_b").select("fps", "fps_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                a, b = (v.values.to_numpy().view(np.uint64) for v in (x, y))
                out.append(_forest(a, b, reach))
            node, root = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(node[node != root]), pa.array(root[node != root])], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``key, fp, component_id``: the smallest key that a row's fingerprint reaches over links of ``reach`` bits.

    Texts without words have fingerprint 0 and are linked like any other.  Repeated rows give repeated
    rows.  A row with a null key gets the component of its fingerprint (null if no row there has a key).
    """
    refuse(key, "fp", "component_id")
    marked = materialize(fingerprints(docs, key, text, shingle, seed))
    distinct = materialize(marked.groupBy("fp").agg(F.min(key).alias("least")))
    joined = components(links(distinct, reach)).withColumnRenamed("node", "fp")
    owned = materialize(distinct.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    heads = materialize(owned.groupBy("component").agg(F.min("least").alias("component_id")))
    named = materialize(owned.join(heads, "component").select("fp", "component_id"))
    return marked.join(named, "fp").select(key, "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = 4, shingle: int = 4) -> DataFrame:
    """The rows of one document of each near-duplicate group, with all their columns.

    The document with the smallest key stays (a null key is the smallest; of a key that repeats, the text with
    the smallest hash).  Rows that repeat it whole stay with it.
    """
    owner, mark = F.col(key), F.xxhash64(F.col(text).cast("string"))
    named = docs.select(F.struct(owner.alias("k"), mark.alias("m")).alias("own"), F.col(text).alias("t"))
    found = near_duplicates(named, "own", "t", reach, shingle)
    heads = found.where("own = component_id").select(F.col("own.k").alias("k"), F.col("own.m").alias("m")).distinct()
    return docs.join(heads, docs[key].eqNullSafe(heads["k"]) & (F.xxhash64(docs[text].cast("string")) == heads["m"]), "left_semi")

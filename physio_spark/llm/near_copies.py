"""Near copies by the Jaccard similarity of word shingles: SimHash and MinHash for candidates, whole sets for the decision.

Texts of one shingle set are one node.  Nodes whose SimHash fingerprints are linked (``simhash.links``) are held
against each other first; MinHash adds the copies of 0.8 that differ in more bits.  A bucket holds the nodes that share a band of their MinHash signature;
a pair of similarity 0.8 shares none of the ``BANDS`` with probability (1 - 0.8**DEPTH)**BANDS, about 0.0004.
Every node is first held against the smallest one of each of its buckets.  Buckets whose nodes do not hang
together after that are cut into blocks, and pairs of blocks answer with a spanning forest of their links.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from . import simhash
from .common import texts
from .components import components

BANDS, DEPTH = 20, 5
REACH = 4  # bits
BLOCK_SHINGLES = 500_000
_ODD = np.random.default_rng(11).integers(1, 1 << 63, (BANDS * DEPTH, 2), np.uint64) | np.uint64(1)


def shingles(text: bytes, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The XXH64 of the distinct word shingles, in order; a text of fewer words is one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-shingle]]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = (digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True))
    return np.unique(np.fromiter(hashes, np.uint64, len(starts)))


def bands(own: np.ndarray) -> list[int]:
    """One number for each band of the MinHash signature of a shingle set; none for an empty set."""
    if not len(own):
        return []
    high = own ^ (own >> np.uint64(32))
    least = np.array([(high * a ^ (high * b >> np.uint64(29))).min() for a, b in _ODD])
    return [xxhash.xxh64_intdigest(least[k * DEPTH : (k + 1) * DEPTH].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def set_fingerprint(own: np.ndarray) -> int:
    """The SimHash of a shingle set as a signed number: bits set in over half of the hashes."""
    ones = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own)).view(np.int64)[0])


def alike(a: np.ndarray, b: np.ndarray, least: Fraction) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches ``least``."""
    small, large = sorted((len(a), len(b)))
    if not large or small < least * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (small + large - both)


def _sets(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint64) for x in column]


def _compared(edges: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """The edges ``a, b`` whose sets are alike."""
    near = edges.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a")
    both = near.join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [alike(x, y, least) for x, y in zip(_sets(batch.column(2)), _sets(batch.column(3)), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a string, b string")


def _forests(pairs: DataFrame, least: Fraction) -> DataFrame:
    """Links ``a, b`` of a spanning forest of each pair of blocks ``left, right`` (arrays of node, component, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1), strict=True):
                x, y = ([(r["node"], r["component"], np.frombuffer(r["own"], np.uint64)) for r in side.as_py()] for side in (left, right))
                head = {c: c for _, c, _ in x + y}

                def root(c: str, head: dict[str, str] = head) -> str:
                    while head[c] != c:
                        c = head[c]
                    return c

                out = []
                for node, c, own in x:
                    for other, d, its in y:
                        if root(c) != root(d) and alike(own, its, least):
                            head[root(c)] = root(d)
                            out.append((node, other))
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in (0, 1)], ["a", "b"])

    return pairs.mapInArrow(run, "a string, b string")


def _marked(rows: DataFrame, shingle: int) -> DataFrame:
    """``own, node, size, fp, bands`` of rows ``own, t``; the node is a digest of the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, shingle) for t in texts(batch.column(1))]
            node = pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in found], pa.string())
            size = pa.array([len(s) for s in found], pa.int64())
            fp = pa.array(list(map(set_fingerprint, found)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), node, size, fp, pa.array(list(map(bands, found)), pa.list_(pa.int64()))], ["own", "node", "size", "fp", "bands"])

    return rows.mapInArrow(run, f"own {rows.schema['own'].dataType.simpleString()}, node string, size long, fp long, bands array<long>")


def _read_again(rows: DataFrame, shingle: int) -> DataFrame:
    """``node, own`` (the set's bytes) of rows ``node, t``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, shingle).tobytes() for t in texts(batch.column(1))], pa.binary())], ["node", "own"])

    return rows.mapInArrow(run, "node string, own binary")


def _hashed(nodes: DataFrame, reach: int) -> DataFrame:
    """Pairs ``a, b`` of nodes that connect all whose fingerprints are linked within ``reach`` bits."""
    heads = materialize(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    equal = nodes.join(heads, "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    near = simhash.links(heads.select("fp"), reach).withColumnsRenamed({"a": "p", "b": "q"}).distinct()
    near = near.join(heads.select(F.col("fp").alias("p"), F.col("head").alias("a")), "p")
    return equal.union(near.join(heads.select(F.col("fp").alias("q"), F.col("head").alias("b")), "q").select("a", "b"))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8, shingle: int = 5) -> DataFrame:
    """``k, m, node, component, least``: each row's key and text hash, its set, the group and its smallest (key, hash).

    Groups are the components of the pairs whose sets have a similarity of ``least`` or more.
    """
    bound = Fraction(str(least))
    mark = F.xxhash64(F.col(text).cast("string"))
    named = docs.select(F.struct(F.col(key).alias("k"), mark.alias("m")).alias("own"), F.col(text).cast("string").alias("t"))
    marked = materialize(_marked(named, shingle))
    nodes = materialize(marked.groupBy("node").agg(F.min("own").alias("first"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    filed = nodes.select("node", "size", F.explode("bands").alias("band"))
    buckets = filed.groupBy("band").agg(F.min("node").alias("head"), F.min(F.struct("node", "size"))["size"].alias("head_size"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = materialize(filed.join(buckets, "band"))
    # one row of each node that meets another lends its text
    hashed = materialize(_hashed(nodes.where("size > 0"), REACH))
    meeting = met.select("node").union(hashed.select("a")).union(hashed.select("b"))
    own = meeting.distinct().join(nodes, "node").select("node", F.col("first.k").alias("k"), F.col("first.m").alias("m"))
    bodies = docs.select(F.col(key).alias("_k"), mark.alias("_m"), F.col(text).cast("string").alias("t"))  # no other column of the table
    lent = bodies.join(own, F.col("_k").eqNullSafe(F.col("k")) & (F.col("_m") == F.col("m"))).select("node", "t")
    sets = materialize(_read_again(lent, shingle).dropDuplicates(["node"]))
    close = F.least("size", "head_size") >= F.lit(least - 1e-9) * F.greatest("size", "head_size")
    stars = met.where((F.col("node") != F.col("head")) & close).select(F.col("node").alias("a"), F.col("head").alias("b")).union(hashed).distinct()
    links = materialize(_compared(stars, sets, bound))
    joined = materialize(components(links))
    # buckets whose nodes do not hang together yet
    placed = met.select("band", "node", "size").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.sum("size").alias("all")).where("lo <> hi").select("band", "all")
    cut = F.pmod(F.xxhash64("node"), F.ceil(F.col("all") / BLOCK_SHINGLES))
    open_ = placed.join(apart, "band").join(sets, "node").groupBy("band", cut.alias("cut")).agg(F.collect_list(F.struct("node", "component", "own")).alias("left"))
    open_ = materialize(open_)
    other = open_.select("band", F.col("cut").alias("cut_b"), F.col("left").alias("right"))
    more = materialize(_forests(open_.join(other, "band").where("cut <= cut_b").select("left", "right"), bound))
    final = components(links.union(more)).withColumnRenamed("node", "at")
    named = materialize(nodes.join(final, nodes["node"] == final["at"], "left").select("node", "first", F.coalesce("component", "node").alias("component")))
    heads = named.groupBy("component").agg(F.min("first").alias("least"))
    whole = named.select("node", "component").join(heads, "component")
    return marked.join(whole, "node").select("own.k", "own.m", "node", "component", "least")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows of one document of each group of near copies, with all their columns.

    The document with the smallest key stays (a null key is the smallest; of a key that repeats, the text with
    the smallest hash).  Rows that repeat it whole stay with it.
    """
    found = near_copies(docs, key, text, least, shingle)
    heads = found.where(F.struct("k", "m").eqNullSafe(F.col("least"))).select("k", "m").distinct()
    return docs.join(heads, docs[key].eqNullSafe(heads["k"]) & (F.xxhash64(docs[text].cast("string")).eqNullSafe(heads["m"])), "left_semi")

"""Target-distribution importance resampling over hashed n-grams.

Every run of one to n words falls into a bucket by its CRC-32.  Bucket counts of the corpus and of a target
give each bucket a gain (a scaled log ratio), a document's weight is its mean gain, and adding Gumbel noise
turns the highest scores into a draw without replacement.

The words are found by an Aho-Corasick automaton over the words with a delimiter on both sides; each carries its
CRC and its length in bytes as payload.  A scan emits payloads in order, and the CRC of a run follows from its
neighbours' payloads alone: the CRC of joined strings is the first one's, shifted by the second one's length, plus
the second.  The automaton belongs to the worker and learns, up to a bound, words that come again; the CRC of any
other word is computed where it stands, so the bound costs time and never a result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize
from .common import Shared, refuse, slices, utf8

# Words of the automaton, bytes of text of one scan, rows that one task ranks.
REMEMBERED = 40_000
BLOCK_BYTES = 4 << 20
RANK_ROWS = 1_000_000
POLYNOMIAL = 0xEDB88320
SCALE = 1000
# Bytes of words stay ([0-9a-z] and all beyond ASCII, A-Z lower-cased), every other byte becomes the delimiter.
FOLDED = np.full(256, 32, np.uint8)
for _lo, _hi in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    FOLDED[_lo:_hi] = np.arange(_lo, _hi)
FOLDED[0x41:0x5B] = np.arange(0x61, 0x7B)


class Shift:
    """CRCs moved on by a number of bytes: table lookups for each power of two in it."""

    def __init__(self) -> None:
        zero = [0] * 256
        for i in range(256):
            c = i
            for _ in range(8):
                c = c >> 1 ^ (POLYNOMIAL if c & 1 else 0)
            zero[i] = c
        self._basis = [zero[1 << i] if i < 8 else 1 << i - 8 for i in range(32)]  # one zero byte appended
        self._tables: list[np.ndarray] = []

    def _table(self, power: int) -> np.ndarray:
        while len(self._tables) <= power:
            table = np.zeros((4, 256), np.uint32)
            for bit, image in enumerate(self._basis):
                rows = np.arange(256) >> bit % 8 & 1 == 1
                table[bit // 8, rows] ^= np.uint32(image)
            self._tables.append(table)
            self._basis = [int(self._apply(table, np.array([b], np.uint32))[0]) for b in self._basis]
        return self._tables[power]

    @staticmethod
    def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]

    def __call__(self, crc: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = crc.astype(np.uint32)
        for power in range(int(size.max()).bit_length() if len(size) else 0):
            own = size >> power & 1 == 1
            out[own] = self._apply(self._table(power), out[own])
        return out


class Words:
    """CRC and length of every word of a block of texts, by an automaton that learns."""

    def __init__(self, _=None) -> None:
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.crc, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.shift = Shift()

    def scan(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``crc, size`` of all words of all texts in order, and where each text's words end."""
        padded = pc.binary_join_element_wise(column.fill_null(""), "", " ")  # a delimiter after each text
        data, at = utf8(padded)
        data = np.concatenate([[np.uint8(32)], FOLDED[data]])
        edges = np.flatnonzero(np.diff(data != 32))
        begin, end = edges[0::2] + 1, edges[1::2] + 1
        text = data.tobytes().decode("latin-1")  # a character for each byte
        payload = np.full(len(end), -1, np.int64)
        if self.crc.size:
            found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
            payload[np.searchsorted(end, found[:, 0])] = found[:, 1]
        crc, size = self.crc[payload] if self.crc.size else np.zeros(len(end), np.uint32), end - begin
        other = np.flatnonzero(payload < 0)
        words = [text[a:b] for a, b in zip(begin[other].tolist(), end[other].tolist(), strict=True)]
        seen = Counter(words)
        own = {w: zlib.crc32(w.encode("latin-1")) for w in seen}
        crc[other] = np.fromiter(map(own.__getitem__, words), np.uint32, len(words))
        self._learn([w for w, n in seen.items() if n > 1], own)
        return crc, size, np.searchsorted(end, at[1:] + 1, "left")

    def _learn(self, words: list[str], crc: dict[str, int]) -> None:
        words = words[: REMEMBERED - len(self.crc)]
        if words:
            for i, w in enumerate(words, len(self.crc)):
                self.automaton.add_word(f" {w} ", i)
            self.automaton.make_automaton()
            self.crc = np.concatenate([self.crc, np.array([crc[w] for w in words], np.uint32)])
            self.size = np.concatenate([self.size, np.array([len(w) for w in words], np.int64)])

    def features(self, column: pa.Array, longest: int, buckets: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """For runs of 1 to ``longest`` words the bucket at each first word and whether the run stays in its text."""
        crc, size, ends = self.scan(column)
        upto = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(crc))  # words from here to the text's end
        spaced = self.shift(np.full(len(crc), zlib.crc32(b" "), np.uint32), size) ^ crc if longest > 1 else crc
        found, fits, run = [], [], crc
        for n in range(1, longest + 1):
            if n > 1:
                run = self.shift(run[: len(run) - 1], size[n - 1 :] + 1) ^ spaced[n - 1 :]
            found.append((run % np.uint32(buckets)).astype(np.int64))
            fits.append(upto[: len(run)] >= n)
        return found, fits, ends


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How many runs of 1 to ``longest`` words of all texts fall into each bucket; nulls have none."""
    shared = Shared(texts.sparkSession, None, Words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = shared.get(), np.zeros(buckets, np.int64)
        for batch in batches:
            for lo, hi in slices(batch.column(0), BLOCK_BYTES):
                for found, fits in zip(*words.features(batch.column(0)[lo:hi], longest, buckets)[:2], strict=True):
                    total += np.bincount(found[fits], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    counted = texts.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():  # a row for each bucket
        out[bucket] = n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored scaled log ratio of every bucket's smoothed share in the target and in the corpus."""
    n, whole_corpus, whole_target = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = lambda s, t: (t + 1.0) * (whole_corpus + n) / ((s + 1.0) * (whole_target + n))
    return np.array([math.floor(SCALE * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(key: Column, seed: str) -> Column:
    """Floored scaled Gumbel noise from a hash of a key's text; a null key counts as an empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weights(docs: DataFrame, gains: np.ndarray, key: str = "doc_id", text: str = "text", longest: int = 1) -> DataFrame:
    """``key, n_words, n_features, weight`` of every row: the floored mean gain of its runs, 0 without any."""
    shared, table = Shared(docs.sparkSession, None, Words), Shared(docs.sparkSession, gains)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own = shared.get(), table.get()
        for batch in batches:
            for lo, hi in slices(batch.column(1), BLOCK_BYTES):
                found, fits, ends = words.features(batch.column(1)[lo:hi], longest, len(own))
                n, total = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                for buckets, fit in zip(found, fits, strict=True):
                    for sums, values in ((n, fit.astype(np.int64)), (total, np.where(fit, own[buckets], 0))):
                        sums += np.diff(np.concatenate([[0], np.cumsum(values)])[np.minimum(ends, len(values))], prepend=0)
                mean = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], *map(pa.array, (np.diff(ends, prepend=0), n, mean))], ["key", "n_words", "n_features", "weight"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_words long, n_features long, weight long").withColumnRenamed("key", key)


def draw(scored: DataFrame, n: int, key: str = "doc_id", eligible: Column | None = None) -> DataFrame:
    """Rows with their ``rank`` (from 1) among the ``n`` highest ``score`` of the eligible; null beyond.

    Ties go to the smaller key, null keys last.  A histogram of the scores (whole numbers of a range that the
    formula bounds) gives the score of the last row drawn; only rows from it on are sorted, by ranges.
    """
    fit = F.coalesce(eligible, F.lit(False)) if eligible is not None else F.lit(True)
    none = F.lit(None).cast("long").alias("rank")
    down = Window.orderBy(F.desc("score"))
    held = scored.where(fit).groupBy("score").count().withColumn("upto", F.sum("count").over(down))
    last = held.where(F.col("upto") >= n).agg(F.max("score").alias("cut"), F.min("upto").alias("rows")).first() if n > 0 else None
    if last is None or last["cut"] is None:  # nothing to draw
        return scored.select("*", none)
    ahead = fit & (F.col("score") >= last["cut"])
    order = [F.desc("score"), F.col(key).asc_nulls_last(), *[F.asc(c) for c in scored.columns if c not in ("score", key)]]
    dealt = scored.where(ahead).repartitionByRange(-(-last["rows"] // RANK_ROWS), *order).sortWithinPartitions(*order)
    placed = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.select("*", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.col("_row") + 1
    ranked = placed.join(F.broadcast(sizes), "_part")  # a row for each partition
    return ranked.select(*scored.columns, F.when(rank <= n, rank).alias("rank")).union(scored.where(~ahead).select("*", none))


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    longest: int = 1,
    buckets: int = 10_000,
    least_words: int = 20,
    percent: int = 10,
    seed: str = "2024",
) -> DataFrame:
    """``key, n_words, n_features, weight, score, rank`` of every row; ``rank`` tells the rows that are drawn.

    Drawn are ``percent`` of the rows with at least ``least_words`` words, highest ``score`` first.  A null or
    empty text has no words and weight 0.  Repeated rows count and are drawn one by one, an empty table gives an
    empty one, and without a target all gains come from the corpus alone.  Other columns are not read.
    """
    refuse(key, "n_words", "n_features", "weight", "score", "rank", "_at", "_part", "_row", "_before")
    gains = bucket_gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets))
    scored = materialize(weights(docs, gains, key, text, longest).withColumn("score", (F.col("weight") + gumbel(F.col(key), seed)).cast("long")))
    eligible = F.col("n_words") >= least_words
    return draw(scored, percent * scored.where(eligible).count() // 100, key, eligible)

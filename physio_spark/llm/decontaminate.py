"""Benchmark decontamination by latent semantic retrieval and longest common subsequences.

All texts are laid out once as word codes, a written table that every later pass reads.  Words are weighted by
document frequencies counted over all documents (TF-IDF).  A distributed randomised SVD of the TF-IDF passages
of all documents gives a latent basis: each task adds up its share of ``A' (A B)`` for the passages ``A`` it
holds, twice, and the driver orthogonalises matrices of words x rank.  Spans whose cosine with an item in this
basis is high are candidates.

A span of ``2 * L + 4`` words holds an item of L words if the longest common subsequence with it is nearly all
of the item, or most of it with the item's answer (its last sentence) found as well, and the words they share
make up most of the item's weight.  A candidate of the latent search is a paraphrase if it holds the answer
in order and by weight, and most of the item's weight with only ``loose`` of it in order: clauses may have
changed places.

No threshold on a cosine can be proven to keep an item among foreign words, so the first rule has a second
source of candidates.  What misses at most 40 % of the weight holds all but 40 % of the weight of any part of
the item, so every such span holds a known weight of the item's rarest words.  This bound is looked up in an
index of these words over all positions of all texts; it loses no span of the first rule.

Items under ``LEAST_WORDS`` words are too short for subsequences: they count where they stand word for word.
Scripts without blanks are read by characters.
"""

from __future__ import annotations

import math
import re
import string
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .common import Shared, refuse, slices, split_words, texts

LEAST_WORDS = 8
BLOCK_BYTES = 4 << 20
SEARCH_BYTES = 1 << 20
SEARCH_WORDS = 1 << 17
REMEMBERED = 200_000
ITEMS_AT_ONCE = 2_000
# Latent basis: buckets of words outside the benchmark, words of a passage, rank and directions beyond it.
FOREIGN = 4096
PASSAGE = 32
RANK, BEYOND = 48, 16
COSINE = 0.7
STRETCH = 1 << 14
SUMMED = 1 << 12  # rows that are gathered at once
PART_ROWS = 1024
SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")
# Thai, Lao, Tibetan, Burmese, Khmer, kana, Bopomofo and Han, which are written without blanks.
PIECE = re.compile("(?P<sign>[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u312f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])|[^\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u312f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")


def plain(word: str) -> str:
    """The word in lower case without signs at its ends."""
    word = word.lower().strip(string.punctuation)
    if word.isalnum():
        return word
    keep = [k for k, c in enumerate(word) if c.isalnum()]
    return word[keep[0] : keep[-1] + 1] if keep else ""


def words_of(raw: str) -> list[str]:
    """The plain words of a text or of a part of it cut at white space; characters of scripts without blanks are words."""
    if raw.isascii():
        return [w for w in map(plain, raw.split()) if w]
    out = []
    for part in raw.split():
        for m in PIECE.finditer(part):
            if m["sign"] is None:
                word = plain(m[0])
            else:
                word = m[0] if m[0].isalnum() or unicodedata.category(m[0])[0] == "M" else ""
            if word:
                out.append(word)
    return out


class Codes(dict):
    """Codes of the plain words in raw ones: a benchmark word's number, or a bucket after these for any other."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        self.vocabulary = vocabulary

    def __missing__(self, raw: bytes) -> tuple[int, ...]:
        if len(self) > REMEMBERED:
            self.clear()
        known, size = self.vocabulary, len(self.vocabulary)
        words = words_of(raw.decode("utf-8", "replace"))
        self[raw] = out = tuple(known[w] if w in known else size + zlib.crc32(w.encode()) % FOREIGN for w in words)
        return out

    @cached_property
    def known(self) -> pa.Array:
        """The words that have a number, in its order."""
        return pa.array(sorted(self.vocabulary, key=self.vocabulary.__getitem__), pa.string())

    def lay(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all words of a string column end to end, and where each text ends.

        Raw words of printable ASCII are looked up together, others one by one.
        """
        distinct, number, ends = split_words(column)
        distinct = distinct.cast(pa.string())
        word = pc.ascii_trim(pc.ascii_lower(distinct), string.punctuation)  # as ``plain``: a letter or digit at both ends, or empty
        usual = pc.ascii_is_printable(distinct).to_numpy(zero_copy_only=False).astype(bool)
        sizes = (pc.binary_length(word).to_numpy(zero_copy_only=False) > 0).astype(np.int64)
        code = pc.index_in(word, self.known).fill_null(-1).to_numpy().astype(np.int64)
        foreign = np.flatnonzero(usual & (code < 0))
        crc = np.fromiter(map(zlib.crc32, texts(word.take(pa.array(foreign)))), np.int64, len(foreign))
        code[foreign] = len(self.vocabulary) + crc % FOREIGN
        odd = np.flatnonzero(~usual)
        parts = list(map(self.__getitem__, texts(distinct.take(pa.array(odd)))))
        sizes[odd] = np.fromiter(map(len, parts), np.int64, len(parts))
        first = np.cumsum(sizes) - sizes
        flat = np.empty(int(sizes.sum()), np.int64)
        usual &= sizes > 0
        flat[first[usual]] = code[usual]
        at = np.repeat(first[odd] - (np.cumsum(sizes[odd]) - sizes[odd]), sizes[odd])
        flat[at + np.arange(len(at))] = np.fromiter(chain.from_iterable(parts), np.int64, len(at))
        count = sizes[number]
        ends = np.concatenate([[0], np.cumsum(count)])[ends]
        if sizes.max(initial=0) <= 1:
            return flat[first[number[count > 0]]], ends
        return flat[np.repeat(first[number] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))], ends


@dataclass
class Item:
    ident: int
    codes: np.ndarray
    answer: np.ndarray

    @cached_property
    def distinct(self) -> set[int]:
        return set(self.codes.tolist())


@dataclass
class Terms:
    """When a span holds an item: shares of its words in order (``paraphrase`` also of its weight), and the cosine of candidates."""

    verbatim: float = 0.8
    paraphrase: float = 0.6
    loose: float = 0.4
    cosine: float = COSINE


@dataclass
class Index:
    """A block of benchmark items with the weights of their words."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    items: list[Item]
    basis: np.ndarray  # words x rank, orthonormal columns
    laid: DataFrame | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"laid": None}


def _groups(batches: Iterator[pa.RecordBatch], column: int, most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, int, pa.Array]]:
    """Stretches of rows of bounded text: the batch, the first row, the texts."""
    for batch in batches:
        for lo, hi in slices(batch.column(column), most):
            yield batch, lo, batch.column(column)[lo:hi]


def lay_out(rows: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """``key, codes`` of all rows ``key, t``, written once; ``codes`` are the word codes end to end as bytes."""
    shared, kind = Shared(rows.sparkSession, vocabulary, Codes), _kind(len(vocabulary) + FOREIGN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, bodies in _groups(batches, 1):
            codes, ends = shared.get().lay(bodies)
            at = np.append(0, ends).astype(np.int64) * kind.itemsize
            laid = pa.Array.from_buffers(pa.large_binary(), len(bodies), [None, pa.py_buffer(at), pa.py_buffer(codes.astype(kind))])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(bodies)), laid.cast(pa.binary())], ["key", "codes"])

    return materialize(rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, codes binary"))


def _kind(size: int) -> np.dtype:
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def _laid(batches: Iterator[pa.RecordBatch], column: int, kind: np.dtype, most: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """Stretches of laid out rows: the batch, the first row, the codes end to end, each row's end."""
    for batch in batches:
        _, offsets, data = batch.column(column).cast(pa.large_binary()).buffers()
        at = np.frombuffer(offsets, np.int64, len(batch) + 1, batch.column(column).offset * 8) if len(batch) else np.zeros(1, np.int64)
        codes = np.frombuffer(data, kind, (at[-1] - at[0]) // kind.itemsize, at[0]) if data else np.zeros(0, kind)
        ends, lo = (at - at[0]) // kind.itemsize, 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1)
            yield batch, lo, codes[ends[lo] : ends[hi]].astype(np.int64), ends[lo + 1 : hi + 1] - ends[lo]
            lo = hi


def document_frequencies(laid: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many texts each code is found, and the number of texts; over all rows of a layout."""
    kind = _kind(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, np.int64), 0
        for _, _, codes, ends in _laid(batches, 0, kind, 1 << 18):
            owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            key = np.sort(_short(owner * size + codes, len(ends) * size))
            total += np.bincount(key[np.append(True, key[1:] != key[:-1])[: len(key)]] % size, minlength=size)
            n += len(ends)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(total[seen], n))], ["code", "n"])

    counted = laid.select("codes").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    codes, n = counted["code"].to_numpy(np.int64), counted["n"].to_numpy(np.int64)
    out[codes[codes >= 0]] = n[codes >= 0]
    return out, int(n[codes < 0].sum())


def _short(key: np.ndarray, size: int) -> np.ndarray:
    """Numbers below ``size`` in 32 bits where they fit, which sort faster."""
    return key.astype(np.uint32) if size <= 1 << 32 else key


def _passages(codes: np.ndarray, ends: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF of the passages of some texts as (passage, word, value), each passage of unit length, in order of passage."""
    sizes = np.diff(ends, prepend=0)
    within = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
    passage = np.cumsum(within % PASSAGE == 0) - 1
    key, times = np.unique(_short(passage * len(idf) + codes, (len(codes) + 1) * len(idf)), return_counts=True)
    row, word = (x.astype(np.int64) for x in np.divmod(key, key.dtype.type(len(idf))))
    value = (1 + np.log(times)) * idf[word]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    return row, word, value / np.sqrt(np.add.reduceat(value * value, first))[row]


def _summed(rows: np.ndarray, at: np.ndarray, values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of ``values[k] * rows[at[k]]`` over each stretch that starts at ``first``: a product for stretches of up to 1, 2, 4, ... rows."""
    sizes = np.diff(first, append=len(at))
    wide = np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    out = np.empty((len(first), rows.shape[1]), rows.dtype)
    for w in np.unique(wide).tolist():
        of = np.flatnonzero(wide == w)
        if not w:
            out[of] = rows.take(at[first[of]], axis=0) * values[first[of], None]
            continue
        most = max(1, SUMMED >> w)
        for lo in range(0, len(of), most):
            part = of[lo : lo + most]
            column = first[part, None] + np.arange(1 << w)
            inside = column < (first[part] + sizes[part])[:, None]
            column[~inside] = 0
            out[part] = np.matmul((values.take(column) * inside)[:, None, :], rows.take(at.take(column), axis=0))[:, 0]
    return out


def gram_product(laid: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``A' (A B)`` of the TF-IDF passages A of all texts and a basis B of words x rank.

    A task adds up its passages and answers with stripes of rows; stripes of the same rows are added in two levels,
    in the order of tasks.  The result has the size of the basis.
    """
    size, rank = basis.shape
    kind, shared = _kind(size), Shared(laid.sparkSession, (idf, basis.astype(np.float32)))
    fold = max(1, math.isqrt(laid.rdd.getNumPartitions()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, given = shared.get()
        total, task = np.zeros((size, rank)), TaskContext.get().partitionId()
        for _, _, codes, ends in _laid(batches, 0, kind, STRETCH):
            for lo in range(0, len(codes), 8 * STRETCH):  # a long text in parts, a whole number of passages each
                part, stop = codes[lo : lo + 8 * STRETCH], np.minimum(ends[ends > lo] - lo, 8 * STRETCH)
                row, word, value = _passages(part, np.unique(stop), own)
                value = value.astype(np.float32)
                inside = _summed(given, word, value, np.flatnonzero(np.diff(row, prepend=-1)))
                order = np.argsort(word.astype(kind), kind="stable")
                first = np.flatnonzero(np.diff(word[order], prepend=-1))
                total[word[order[first]]] += _summed(inside, row[order], value[order], first)
        stripes = [(k, total[k : k + PART_ROWS]) for k in range(0, size, PART_ROWS)]
        stripes = [(k, x.astype("<f8").tobytes()) for k, x in stripes if x.any()]
        columns = [pa.array([k for k, _ in stripes], pa.int64()), pa.array([task] * len(stripes), pa.int64()), pa.array([x for _, x in stripes], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["part", "task", "rows"])

    def added(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("task")
        total = sum(np.frombuffer(x, "<f8") for x in group["rows"])
        return pd.DataFrame({"part": group["part"].iloc[:1], "task": group["task"].iloc[:1], "rows": [total.tobytes()]})

    schema = "part long, task long, rows binary"
    some = laid.select("codes").mapInArrow(run, schema)
    some = some.groupBy("part", F.floor(F.col("task") / fold)).applyInPandas(added, schema)
    out = np.zeros((size, rank))
    for r in some.groupBy("part").applyInPandas(added, schema).collect():
        rows = np.frombuffer(r["rows"], "<f8").reshape(-1, rank)
        out[r["part"] : r["part"] + len(rows)] = rows
    return out


def latent_basis(laid: DataFrame, idf: np.ndarray) -> np.ndarray:
    """The leading right singular vectors of the TF-IDF passages of all texts: words x ``RANK``, the largest first."""
    start = np.random.default_rng(7).standard_normal((len(idf), min(RANK + BEYOND, len(idf))))
    range_of = np.linalg.qr(gram_product(laid, idf, np.linalg.qr(start)[0]))[0]
    inner = range_of.T @ gram_product(laid, idf, range_of)
    _, turn = np.linalg.eigh((inner + inner.T) / 2)
    return range_of @ turn[:, ::-1][:, :RANK]


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by Hyyrö's bit-parallel recurrence."""
    masks: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for y in b.tolist():
        m = masks.get(y, 0)
        if m:
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def _span(size: int) -> int:
    return 2 * size + 4


def _width(size: int) -> int:
    """Width of the windows in which an item is searched for: steps of a quarter, so that a window is near its length."""
    step = max(1, 1 << max(0, size.bit_length() - 3))
    return -(-size // step) * step


class Searcher:
    """The items of a block with an index of their rarest words."""

    def __init__(self, index: Index) -> None:
        self.index, self.codes = index, Codes(index.vocabulary)
        self.words = len(index.vocabulary)
        self.sizes = np.array([len(i.codes) for i in index.items])
        self.bits = np.zeros((len(index.items), self.words // 8 + 1), np.uint8)
        for k, item in enumerate(index.items):
            own = np.array(sorted(item.distinct))
            np.bitwise_or.at(self.bits[k], own >> 3, (1 << (own & 7)).astype(np.uint8))
        self.idf = index.idf.astype(np.float64)
        self.weight = np.array([self.idf[list(i.distinct)].sum() for i in index.items])
        self.bound = 0.0
        self.placed = (self.idf[:, None] * index.basis).astype(np.float32)
        self.classes = []
        for wide in dict.fromkeys(sorted(_width(n) for n in self.sizes.tolist() if n >= LEAST_WORDS)):
            own = np.array([k for k, n in enumerate(self.sizes.tolist()) if n >= LEAST_WORDS and _width(n) == wide])
            points = np.array([self.placed[self.index.items[k].codes].sum(0, dtype=np.float64) for k in own])
            length = np.linalg.norm(points, axis=1)[:, None]
            self.classes.append((wide, own, np.divide(points, length, out=np.zeros_like(points), where=length > 1e-9).astype(np.float32)))

    def holds(self, item: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Whether the words are among those of the items; foreign words are none."""
        known = np.minimum(codes, self.words)
        return (self.bits[item, known >> 3] >> (known & 7) & 1).astype(bool)

    def near(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray, items: np.ndarray, places: np.ndarray, cosine: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Width, items and first words of the windows whose latent cosine with an item of about their width is high.

        Windows start at every quarter of their width.  ``items, places`` are those of the index: a window that holds
        no place of an item cannot share the weight that is asked for, so its cosine is not computed.
        """
        for wide, own, points in self.classes:
            step = max(1, wide // 4)
            column = np.full(len(self.index.items), -1)
            column[own] = np.arange(len(own))
            of = column[items] >= 0
            place, which = places[of], column[items[of]]
            first = begin[place]
            last = (place - first) // step * step
            back = np.arange(-(-wide // step)) * step
            start, which = first[:, None] + last[:, None] - back, np.broadcast_to(which[:, None], (len(which), len(back)))
            holds = (start >= first[:, None]) & (start + wide > place[:, None])
            start, which = np.divmod(np.unique(start[holds] * len(own) + which[holds]), len(own))
            for lo in range(0, len(start), 256):
                starts, row = np.unique(start[lo : lo + 256], return_inverse=True)
                at = starts[:, None] + np.arange(wide)
                words = self.placed[codes[np.minimum(at, len(codes) - 1)]]
                there = np.einsum("ijk,ij->ik", words, (at < end[starts][:, None]).astype(np.float32))
                cosines = there @ points.T
                some = cosines[row, which[lo : lo + 256]] >= cosine * np.maximum(np.linalg.norm(there, axis=1), 1e-6)[row]
                yield wide, own[which[lo : lo + 256][some]], start[lo : lo + 256][some]

    def rare(self, paraphrase: float) -> None:
        """Index the rarest words of each item that make up more than it may miss, and the weight that must be met.

        Of an item that has to stand word for word, the rarest word is enough.
        """
        if self.bound == paraphrase:
            return
        self.bound = paraphrase
        pairs, self.least = [], np.zeros(len(self.index.items))
        self.anchor = np.full(len(self.index.items), -1)
        for k, item in enumerate(self.index.items):
            order = sorted(item.distinct, key=lambda c: (-self.idf[c], c))
            if len(item.codes) < LEAST_WORDS:
                self.anchor[k] = item.codes.tolist().index(order[0])
                pairs.append((order[0], k))
                continue
            missed, total = (1 - paraphrase) * self.weight[k], 0.0
            for c in order:
                pairs.append((c, k))
                total += self.idf[c]
                if total > min(missed + 0.2 * self.weight[k], 0.999 * self.weight[k]):
                    break
            self.least[k] = (total - missed) * (1 - 1e-6)
        code, self.whose = np.array(sorted(pairs), np.int64).reshape(-1, 2).T
        self.first = np.searchsorted(code, np.arange(self.words + 1))

    def candidates(self, codes: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and places of their rare words from where a span may reach the weight; in order of item and place."""
        at = np.flatnonzero(codes < self.words)
        count = self.first[codes[at] + 1] - self.first[codes[at]]
        at, count = at[count > 0], count[count > 0]
        place = np.repeat(at, count)
        item = self.whose[np.repeat(self.first[codes[at]] - (np.cumsum(count) - count), count) + np.arange(len(place))]
        order = np.argsort(item, kind="stable")
        place, item = place[order], item[order]
        weight = np.concatenate([[0.0], np.cumsum(self.idf[codes[place]])])
        stop = np.minimum(place + _span(self.sizes[item]), end[place])
        base = item * (len(codes) + 1)
        some = weight[np.searchsorted(base + place, base + stop)] - weight[:-1] >= self.least[item] - 1e-6
        return item[some], place[some]

    def runs(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int]]:
        """Place and item of short items that stand word for word."""
        for k in np.unique(item).tolist():
            own = self.index.items[k].codes
            at = place[item == k]
            start = at - self.anchor[k]
            inside = (start >= begin[at]) & (start + len(own) <= end[at])
            start = start[inside]
            for a in start[(codes[start[:, None] + np.arange(len(own))] == own).all(1)].tolist():
                yield a, k

    def best(self, item: int, region: np.ndarray, starts: range, verbatim: float, paraphrase: float) -> tuple[float, bool] | None:
        """The largest similarity of the spans of a region from these starts that hold the item, and whether one has its answer."""
        own = self.index.items[item]
        most = common_length(own.codes, region)
        if most < paraphrase * len(own.codes):
            return None
        answer = common_length(own.answer, region) >= 0.8 * len(own.answer)
        found = None
        step = max(1, len(own.codes) // 4)
        for a in dict.fromkeys([*starts[::step], *starts]):
            span = region[max(a, 0) : a + _span(len(own.codes))]
            shared = own.distinct.intersection(span.tolist())
            if self.idf[list(shared)].sum() < paraphrase * self.weight[item] - 1e-6:  # common words alone are no leak
                continue
            same = common_length(own.codes, span) / len(own.codes)
            if same < paraphrase:
                continue
            answered = answer and common_length(own.answer, span) >= 0.8 * len(own.answer)
            if same < verbatim and not answered:
                continue
            found = max(found or (0.0, False), (same, answered))
            if found == (most / len(own.codes), answer):
                break
        return found

    def latent(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray, near: tuple[np.ndarray, np.ndarray], terms: Terms) -> Iterator[tuple[int, int, tuple[float, bool]]]:
        """Place, item, similarity and answer of the confirmed candidates of the latent search.

        The window shares ``paraphrase`` of the item's weight; the span of ``2 * L + 4`` words around it is compared.
        """
        for wide, items, starts in self.near(codes, begin, end, *near, terms.cosine):
            for lo in range(0, len(items), 1 << 15):
                item, start = items[lo : lo + (1 << 15)], starts[lo : lo + (1 << 15)]
                at = start[:, None] + np.arange(wide)
                inside = at < end[start][:, None]
                around = codes[np.minimum(at, len(codes) - 1)]
                shared = np.where(self.holds(item[:, None], around) & inside, self.idf[around], 0.0).sum(1)
                some = shared >= terms.paraphrase * self.weight[item] - 1e-6  # a repeated word counts twice: an upper bound
                for k, a in zip(item[some].tolist(), start[some].tolist(), strict=True):
                    own, stop = self.index.items[k], int(end[a])
                    weight = self.idf[list(own.distinct.intersection(codes[a : min(a + wide, stop)].tolist()))].sum() / self.weight[k]
                    if weight < terms.paraphrase - 1e-6:
                        continue
                    spare = max(0, _span(len(own.codes)) - wide)
                    span = codes[max(int(begin[a]), a - spare // 2) : min(stop, a + wide + spare - spare // 2)]
                    same = common_length(own.codes, span) / len(own.codes)
                    if same < terms.loose:
                        continue
                    answered = common_length(own.answer, span) >= 0.8 * len(own.answer)
                    known, wanted = set(span.tolist()), set(own.answer.tolist())
                    told = self.idf[list(known & wanted)].sum() >= 0.8 * self.idf[list(wanted)].sum()  # common words alone are no answer
                    if answered and told or same >= terms.verbatim:
                        yield a, k, (same, answered)

    def search(self, codes: np.ndarray, ends: np.ndarray, terms: Terms) -> dict[tuple[int, int], tuple[float, bool]]:
        """Similarity and answer by (text, item) of all confirmed pairs in texts whose codes stand end to end."""
        verbatim, paraphrase = terms.verbatim, terms.paraphrase
        self.rare(min(verbatim, paraphrase))
        sizes = np.diff(np.concatenate([[0], ends]))
        begin, end = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
        owner = np.repeat(np.arange(len(ends)), sizes)
        found: dict[tuple[int, int], tuple[float, bool]] = {}
        items, places = self.candidates(codes, end)
        short = self.anchor[items] >= 0
        for a, k, same in self.latent(codes, begin, end, (items[~short], places[~short]), terms):
            pair = (int(owner[a]), self.index.items[k].ident)
            found[pair] = max(found.get(pair, (0.0, False)), same)
        for a, k in self.runs(codes, begin, end, items[short], places[short]):
            found[int(owner[a]), self.index.items[k].ident] = (1.0, True)
        items, places = items[~short], places[~short]
        reach = _span(self.sizes[items])
        some = np.zeros(len(items), bool)
        for size in np.unique(self.sizes[items]).tolist():  # no subsequence is longer than the item's words around
            of = np.flatnonzero(self.sizes[items] == size)
            for lo in range(0, len(of), 4096):
                part = of[lo : lo + 4096]
                at = places[part, None] + np.arange(1 - _span(size), _span(size))
                inside = (at >= begin[places[part], None]) & (at < end[places[part], None])
                around = codes[np.clip(at, 0, len(codes) - 1)]
                some[part] = (self.holds(items[part, None], around) & inside).sum(1) >= paraphrase * size
        items, places, reach = items[some], places[some], reach[some]
        if not len(items):
            return found
        # neighbours of an item in a text are looked at together, a few spans at a time
        breaks = (np.diff(items) != 0) | (np.diff(owner[places]) != 0) | (np.diff(places) > reach[1:]) | (places[1:] // (8 * reach[1:]) != places[:-1] // (8 * reach[1:]))
        edges = np.concatenate([[0], np.flatnonzero(breaks) + 1, [len(items)]])
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            k, a, b, wide = int(items[x]), int(places[x]), int(places[y - 1]), int(reach[x])
            lo, hi = max(int(begin[a]), a - wide + 1), min(int(end[a]), b + wide)
            same = self.best(k, codes[lo:hi], range(0, b - lo + 1), verbatim, paraphrase)
            if same:
                pair = (int(owner[a]), self.index.items[k].ident)
                found[pair] = max(found.get(pair, (0.0, False)), same)
        return found


def _answer(text: str) -> list[str]:
    parts = [w for w in map(words_of, SENTENCE.split(text)) if w]
    last = parts[-1] if parts else []
    return last if len(last) >= 3 else words_of(text)[-5:]


def fit(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> list[Index]:
    """The benchmark as indexes of at most ``ITEMS_AT_ONCE`` items each, with the documents laid out for them.

    Document frequencies and the latent basis come from all documents.  Items that are null or have no word are left out.
    """
    rows = benchmark.select(F.col(item).alias("i"), F.col(item_text).cast("string").alias("t")).dropna()
    body = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t"))
    blocks = math.ceil(rows.count() / ITEMS_AT_ONCE)
    out = []
    for block in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect()
        read = [(r["i"], words_of(r["t"]), _answer(r["t"])) for r in own]
        read = [x for x in read if x[1]]
        if not read:
            continue
        vocabulary = {w: k for k, w in enumerate(sorted({w for _, words, _ in read for w in words}))}
        code = lambda words: np.array([vocabulary[w] for w in words], np.int64)  # noqa: E731, B023
        items = [Item(i, code(words), code(answer)) for i, words, answer in read]
        laid = lay_out(body, vocabulary)
        counts, n = document_frequencies(laid, len(vocabulary) + FOREIGN)
        idf = np.log((n + len(items) + 1) / (counts + 1.0)).astype(np.float32) + 0.01
        out.append(Index(vocabulary, idf, items, latent_basis(laid, idf), laid))
    return out


def leaks(docs: DataFrame, indexes: list[Index], key: str = "doc_id", text: str = "text", verbatim: float = 0.8, paraphrase: float = 0.6, loose: float = 0.4, cosine: float = COSINE, fitted: bool = False) -> DataFrame:
    """``key, item_id, similarity, answer_found`` of every document that holds an item.

    ``similarity`` is the share of the item's words in the longest common subsequence, 1 for a short item that stands word for word.  With ``fitted``
    the documents are those of the fit and are read from its layout.  Null and empty texts hold nothing, nor does an empty benchmark find
    anything; repeated rows give repeated rows.
    """
    refuse(key, "item_id", "similarity", "answer_found")
    terms = Terms(verbatim, paraphrase, loose, cosine)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, item_id long, similarity double, answer_found boolean"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in indexes:
        shared, form = Shared(docs.sparkSession, index, Searcher), _kind(len(index.idf))

        def run(batches: Iterator[pa.RecordBatch], shared: Shared = shared, form: np.dtype = form) -> Iterator[pa.RecordBatch]:
            searcher = shared.get()
            if fitted:
                laid = _laid(batches, 1, form, SEARCH_WORDS)
            else:
                laid = ((batch, first, *searcher.codes.lay(bodies)) for batch, first, bodies in _groups(batches, 1, SEARCH_BYTES))
            for batch, first, codes, ends in laid:
                found = sorted(searcher.search(codes, ends, terms).items())
                place = pa.array([first + row for (row, _), _ in found], pa.int64())
                columns = [pa.array([i for (_, i), _ in found], pa.int64()), pa.array([s for _, (s, _) in found], pa.float64()), pa.array([a for _, (_, a) in found], pa.bool_())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(place), *columns], ["key", "item_id", "similarity", "answer_found"])

        out = out.union((index.laid if fitted else rows).mapInArrow(run, schema))
    return out.withColumnRenamed("key", key)


def keep_clean(docs: DataFrame, indexes: list[Index], text: str = "text", verbatim: float = 0.8, paraphrase: float = 0.6, loose: float = 0.4, cosine: float = COSINE) -> DataFrame:
    """The rows that hold no item, with all their columns, in one pass without a shuffle."""
    at, terms = docs.columns.index(text), Terms(verbatim, paraphrase, loose, cosine)
    out = docs
    for index in indexes:
        shared = Shared(docs.sparkSession, index, Searcher)

        def run(batches: Iterator[pa.RecordBatch], shared: Shared = shared) -> Iterator[pa.RecordBatch]:
            searcher = shared.get()
            for batch, first, bodies in _groups(batches, at, SEARCH_BYTES):
                clean = np.ones(len(bodies), bool)
                clean[[row for row, _ in searcher.search(*searcher.codes.lay(bodies), terms)]] = False
                yield batch.slice(first, len(bodies)).filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out

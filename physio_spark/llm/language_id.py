"""Language identification by prediction by partial matching.

Every language has a byte context tree of order 3, learned once and then frozen.  A byte costs
-log2 of its probability in the longest context that the language has seen; an unseen byte pays the
escape of that context (method C: q / (n + q) for q different successors among n) and is asked of the
next shorter one, down to 1/256.  The language with the fewest bits for the whole text wins.

The frozen cost of a byte depends on nothing but the three bytes before it, so it is tabulated: a
text is scored by two array look-ups per byte, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, refuse, unit, utf8

ORDER = 3
START = ord("\n")
UNKNOWN = "und"
# Order-3 contexts with fewer occurrences in every language are left to their order-2 suffix.
LEAST_CONTEXT = 4
CHUNK = 1 << 20


@dataclass
class ContextTrees:
    """Frozen statistics: for each language the counts of every four-byte run (context and byte)."""

    langs: list[str]
    runs: list[np.ndarray]
    counts: list[np.ndarray]


def _windows(data: np.ndarray, at: np.ndarray, lo: int = 0, hi: int | None = None) -> list[np.ndarray]:
    """For positions lo to hi the three bytes before and the byte itself; texts start after newlines."""
    hi = len(data) if hi is None else hi
    first = max(0, lo - ORDER)
    part = data[first:hi]
    shifted = []
    starts = at[:-1][np.diff(at) > 0]
    for back in range(ORDER, 0, -1):
        col = np.full(hi - lo, START, np.uint8)
        have = lo - back
        a = max(have, first)
        col[a - have :] = part[a - first : hi - back - first]
        for k in range(back):  # the first bytes of a text see no byte of the text before it
            p = starts + k
            p = p[(p >= lo) & (p < hi)] - lo
            col[p] = START
        shifted.append(col)
    return [*shifted, data[lo:hi]]


def fit(labelled: DataFrame, key: str, text: str, lang: str, per_language: int = 2_000) -> ContextTrees:
    """Learn the trees from rows with a text and a language.

    The fit is bounded: of a language with more than ``per_language`` rows about that many are taken,
    chosen by a hash of their key.  Rows with a null key, text or language are not used.
    """
    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).dropna()
    sizes = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    if not sizes:
        return ContextTrees([], [], [])
    share = F.create_map(*[x for l, n in sizes.items() for x in (F.lit(l), F.lit(min(1.0, per_language / n)))])
    chosen = rows.where(unit(F.col("k")) < share[F.col("l")]).select("l", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0)
            for name in names.unique().to_pylist():
                data, at = utf8(batch.column(1).filter(pc.equal(names, name)))
                for lo in range(0, len(data), 4 * CHUNK):
                    b3, b2, b1, b0 = (x.astype(np.uint32) for x in _windows(data, at, lo, min(len(data), lo + 4 * CHUNK)))
                    run, n = np.unique(b3 << 24 | b2 << 16 | b1 << 8 | b0, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(run)), pa.array(run.astype(np.int64)), pa.array(n)], ["l", "run", "n"])

    counted = chosen.mapInArrow(count, "l string, run long, n long").groupBy("l", "run").agg(F.sum("n").alias("n")).toArrow()
    found = counted.to_pandas().sort_values(["l", "run"])
    langs = sorted(found["l"].unique())
    parts = [found[found["l"] == l] for l in langs]
    return ContextTrees(langs, [p["run"].to_numpy(np.uint32) for p in parts], [p["n"].to_numpy(np.int64) for p in parts])


class Coder:
    """Code lengths of every (context, byte) under every language's frozen tree."""

    def __init__(self, trees: ContextTrees) -> None:
        self.langs = trees.langs
        seen = np.zeros(256, bool)
        seen[START] = True
        for run in trees.runs:
            for shift in (24, 16, 8, 0):
                seen[np.unique(run >> shift & 255)] = True
        self.size = size = int(seen.sum()) + 1  # one more for all bytes that no language has seen
        self.symbol = np.full(256, size - 1, np.int32)
        self.symbol[seen] = np.arange(size - 1)
        split = [[self.symbol[run >> shift & 255].astype(np.int64) for shift in (24, 16, 8, 0)] for run in trees.runs]
        deep = np.zeros(0, np.int64)
        for (a, b, c, _), n in zip(split, trees.counts, strict=True):
            context, where = np.unique((a * size + b) * size + c, return_inverse=True)
            deep = np.union1d(deep, context[np.bincount(where, n) >= LEAST_CONTEXT])
        states = size * size + len(deep)
        self.state = np.tile(np.arange(size * size, dtype=np.int32), size)
        self.state[deep] = np.arange(size * size, states)
        self.bits = np.empty((states * size, len(self.langs)), np.float32)
        for k, ((a, b, c, s), n) in enumerate(zip(split, trees.counts, strict=True)):
            p = np.full(size, 1 / 256)
            p = self._longer(p[None, :], np.bincount(s, n, size).reshape(1, size))
            p = self._longer(np.repeat(p, size, 0), np.bincount(c * size + s, n, size**2).reshape(-1, size))
            p = self._longer(np.tile(p, (size, 1)), np.bincount((b * size + c) * size + s, n, size**3).reshape(-1, size))
            where = self.state[(a * size + b) * size + c] - size * size
            own = where >= 0
            top = np.bincount(where[own] * size + s[own], n[own], len(deep) * size).reshape(-1, size)
            p = np.concatenate([p, self._longer(p[deep % (size * size)], top)])
            self.bits[:, k] = -np.log2(p).ravel()

    @staticmethod
    def _longer(shorter: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
        below = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
        return np.where(counts > 0, counts / np.maximum(total + kinds, 1), below * shorter)

    def score(self, column: pa.Array) -> np.ndarray:
        """Bits of each text under each language."""
        data, at = utf8(column)
        total = np.zeros((len(at) - 1, len(self.langs)))
        filled = np.flatnonzero(np.diff(at) > 0)
        starts = at[:-1][filled]
        for lo in range(0, len(data), CHUNK):
            hi = min(len(data), lo + CHUNK)
            a, b, c, s = (self.symbol[x] for x in _windows(data, at, lo, hi))
            cost = self.bits[self.state[(a * self.size + b) * self.size + c].astype(np.int64) * self.size + s]
            first = np.searchsorted(starts, lo, "right") - 1
            last = np.searchsorted(starts, hi, "left")
            cuts = np.maximum(starts[first:last] - lo, 0)
            total[filled[first:last]] += np.add.reduceat(cost, cuts, axis=0, dtype=np.float64)
        return total


def _letters(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def _decide(shared: Shared, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, probability and bits per byte of each row."""
    size = np.diff(utf8(column)[1])
    letters = _letters(column)
    coder = shared.get()
    if not coder.langs:
        return [UNKNOWN] * len(size), np.zeros(len(size)), np.zeros(len(size))
    bits = coder.score(column)
    best = bits.argmin(1)  # the first of equals, in the order of names
    least = bits[np.arange(len(best)), best]
    probability = np.where(letters, 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1), 0.0)
    names = [coder.langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), letters.tolist(), strict=True)]
    return names, probability, np.where(letters, least / np.maximum(size, 1), 0.0)


def identify(docs: DataFrame, trees: ContextTrees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score, bits_per_byte`` of each row, in one pass without a shuffle.

    A text that is null or holds no letter, or any text when nothing was learned, is ``und`` with score
    0.  The score is the posterior of the language under equal priors.  Equal code lengths fall to the
    smaller name.  Repeated rows give repeated rows; other columns are not looked at, and ``key`` may not have
    the name of a result column.
    """
    refuse(key, "lang_pred", "score", "bits_per_byte")
    shared = Shared(docs.sparkSession, trees, Coder)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, p, rate = _decide(shared, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(p), pa.array(rate)], ["key", "lang_pred", "score", "bits_per_byte"])

    out = rows.mapInArrow(run, f"key {kind}, lang_pred string, score double, bits_per_byte double")
    return out.withColumnRenamed("key", key)


def keep_identified(docs: DataFrame, trees: ContextTrees, text: str = "text") -> DataFrame:
    """The rows whose language is known, with all their columns.

    Rejected are texts without a letter (or null), and texts that the best language codes in no fewer
    than the 8 bits per byte that no model at all needs.  Where nothing was learned, letters suffice.
    """
    shared = Shared(docs.sparkSession, trees, Coder)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, rate = _decide(shared, batch.column(at))
            yield batch.filter(pa.array(_letters(batch.column(at)) & (rate < 8)))

    return docs.mapInArrow(run, docs.schema)


def accuracy(predicted: pd.DataFrame, truth: pd.DataFrame, key: str = "doc_id") -> float:
    """Share of rows whose predicted language is the true one."""
    both = predicted.merge(truth, on=key)
    return float((both["lang_pred"] == both["lang"]).mean()) if len(both) else 1.0

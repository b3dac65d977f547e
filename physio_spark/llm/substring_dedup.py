"""Repeated word windows by super-k-mer partitioning.

A window of 50 words has a minimiser: the smallest hash of its word triples.  Consecutive windows that
share one travel as a single packed string to the bucket of that minimiser, where equal windows meet.
A bucket sorts its windows, compares neighbours word by word and tells which of them start in a
smaller document too.

A first pass notes the minimisers of all documents in Bloom filters of those seen once and seen twice.
A window that two documents start has a minimiser that two documents have; strings of other
minimisers stay at home.

Two more things keep buckets small.  Every task first combines the windows of its own documents, so that a
passage of a third of all documents reaches its bucket once for each task and not once for each document.
And triples that are the minimiser of a large share of all strings come last in the order of minimisers,
so that windows which merely touch a frequent line are spread by the words around it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from . import bloom
from .common import Shared, fresh, refuse, split_words, texts, widened, without

GRAM = 3
# Words that one task lays out at once, and the share of all packed strings that makes a triple frequent.
BLOCK_WORDS = 1 << 19
FREQUENT = 2_000
FLUSH = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


_power_cache: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse, modulo 2**64."""
    if not _power_cache or len(_power_cache[0]) < n + 1:
        size = max(n + 1, 2 * BLOCK_WORDS)
        _power_cache[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)]), dtype=np.uint64) for x in (_STEP, _BACK)]
    return _power_cache[0], _power_cache[1]


def _mixed(minimisers: np.ndarray) -> np.ndarray:
    """Minimisers are the small ones among hashes; spread over all bits again."""
    x = minimisers * _STEP
    return (x ^ (x >> np.uint64(31))) * _BACK


class Block:
    """Word runs of several documents laid end to end, in the order of their documents.

    A run is (document, mark, place of its first word, words joined by white space).
    """

    def __init__(self, runs: list[tuple], window: int, judge: bool = True) -> None:
        self.runs, self.window = sorted(runs, key=lambda r: (r[0], r[1], r[2])), window
        self.distinct, self.ids, self.ends = split_words(pa.array([r[3] for r in self.runs], pa.binary()).cast(pa.string()))
        n = len(self.ids)
        hashes = [xxhash.xxh3_64_intdigest(w) for w in self.distinct.cast(pa.binary()).to_pylist()]
        self.hashes = np.array(hashes, np.uint64)[self.ids] if n else np.zeros(0, np.uint64)
        sizes = np.diff(np.concatenate([[0], self.ends]))
        self.begins = self.ends - sizes
        self.run_of = np.repeat(np.arange(len(sizes)), sizes)
        self.at = np.flatnonzero(np.arange(n) + window <= self.ends[self.run_of]) if n else np.zeros(0, np.int64)
        docs = [r[0] for r in self.runs]
        self.doc = np.cumsum([0] + [a != b for a, b in zip(docs[1:], docs[:-1], strict=True)]) if docs else np.zeros(0, np.int64)
        self.repeated = self._repeats() if judge else np.zeros(len(self.at), bool)

    def _window_hashes(self) -> np.ndarray:
        n = len(self.hashes)
        up, down = _powers(n)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes * up[:n], dtype=np.uint64)])
        return (total[self.at + self.window] - total[self.at]) * down[self.at]

    def _repeats(self) -> np.ndarray:
        """For each window, whether a smaller document of the block starts it too."""
        out = np.zeros(len(self.at), bool)
        if not len(out):
            return out
        h = self._window_hashes()
        order = np.argsort(h)
        sorted_h, places = h[order], self.at[order]
        starts = np.flatnonzero(np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]]))
        if len(starts) == len(order):
            return out
        least = np.minimum.reduceat(places, starts)  # documents are laid in order: the first place is the smallest one's
        leader = np.full(len(self.ids), -1, np.int64)
        leader[places] = np.repeat(least, np.diff(np.append(starts, len(order))))
        own = self.at[leader[self.at] != self.at]
        other = leader[own]
        last = self.window - 1
        same = self.ids[own + last] == self.ids[other + last]
        before = own - 1  # a window next to one that repeats its leader's neighbour differs in its last word only
        follows = (own > 0) & (leader[before] == other - 1) & (leader[before] != before) & (leader[before] >= 0)
        alone = np.flatnonzero(~follows)
        for k in range(last):
            same[alone] &= self.ids[own[alone] + k] == self.ids[other[alone] + k]
        if same.all():
            out[leader[self.at] != self.at] = self.doc[self.run_of[own]] > self.doc[self.run_of[other]]
            return out
        first: dict[bytes, int] = {}  # two windows share a hash: compare all by their words
        for k, p in enumerate(self.at.tolist()):
            owner = self.doc[self.run_of[p]]
            out[k] = first.setdefault(self.ids[p : p + self.window].tobytes(), owner) < owner
        return out

    def _minimisers(self, frequent: np.ndarray) -> np.ndarray:
        """The smallest triple of each window; frequent ones are larger than all others."""
        n = len(self.hashes) - GRAM + 1
        mixed = np.zeros(n, np.uint64)
        for k in range(GRAM):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _STEP + self.hashes[k : k + n]
        mixed = ((mixed ^ (mixed >> np.uint64(32))) * _STEP) >> np.uint64(1)
        if len(frequent):
            near = np.minimum(np.searchsorted(frequent, mixed), len(frequent) - 1)
            mixed |= (frequent[near] == mixed).astype(np.uint64) << np.uint64(63)
        width, span = 1, self.window - GRAM + 1
        low = mixed
        while 2 * width <= span:
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        if span > width:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        return low[self.at]

    def _groups(self, chosen: np.ndarray, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First window and number of windows of each stretch of chosen windows with one label."""
        places = self.at[chosen]
        if not len(places):
            return places, places
        cut = places[1:] != places[:-1] + 1
        if labels is not None:
            cut |= labels[chosen][1:] != labels[chosen][:-1]
        first = np.concatenate([[0], np.flatnonzero(cut) + 1])
        return places[first], np.diff(np.append(first, len(places)))

    def removed(self) -> Iterator[tuple]:
        """(document, mark, first word, end) of the stretches that repeated windows cover."""
        for a, n in zip(*(x.tolist() for x in self._groups(self.repeated)), strict=True):
            doc, mark, start, _ = self.runs[self.run_of[a]]
            begin = start + a - int(self.begins[self.run_of[a]])
            yield doc, mark, begin, begin + n + self.window - 1

    def _joined(self) -> tuple[bytes, np.ndarray]:
        """All words joined by blanks, and the place after each word and its blank."""
        words = pa.ListArray.from_arrays(pa.array([0, len(self.ids)], pa.int32()), self.distinct.take(pa.array(self.ids)))
        size = pc.binary_length(self.distinct).to_numpy(zero_copy_only=False).astype(np.int64)
        return pc.binary_join(words, " ")[0].as_buffer().to_pybytes(), np.cumsum(size[self.ids] + 1)

    def packed(self, frequent: np.ndarray, twice: np.ndarray) -> Iterator[tuple]:
        """(minimiser, document, mark, first word, words) of the stretches of other windows that may repeat."""
        if not len(self.at):
            return
        chosen = ~self.repeated
        noted = self._minimisers(np.zeros(0, np.uint64))
        chosen[chosen] = bloom.holds(twice, _mixed(noted[chosen]))
        if not chosen.any():
            return
        least = self._minimisers(frequent)
        joined, ends = self._joined()
        firsts, counts = self._groups(chosen, least)
        place = np.searchsorted(self.at, firsts)
        run = self.run_of[firsts]
        lo = np.where(firsts > 0, ends[firsts - 1], 0)
        hi = ends[firsts + counts + self.window - 2] - 1
        begin = firsts - self.begins[run]
        for key, r, b, x, y in zip(least[place].view(np.int64).tolist(), run.tolist(), begin.tolist(), lo.tolist(), hi.tolist(), strict=True):
            doc, mark, start, _ = self.runs[r]
            yield key, doc, mark, start + b, joined[x:y]

    def survivors(self) -> list[tuple]:
        """Runs of the windows that no smaller document of the block starts."""
        out = []
        joined, ends = self._joined()
        for a, n in zip(*(x.tolist() for x in self._groups(~self.repeated)), strict=True):
            doc, mark, start, _ = self.runs[self.run_of[a]]
            body = joined[ends[a - 1] if a else 0 : ends[a + n + self.window - 2] - 1]
            out.append((doc, mark, start + a - int(self.begins[self.run_of[a]]), body))
        return out


def _blocks(batches: Iterator[pa.RecordBatch], window: int, judge: bool = True) -> Iterator[Block]:
    runs: list[tuple] = []
    size = 0
    for batch in batches:
        for doc, mark, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True):
            runs.append((doc, mark, 0, body))
            size += len(body)
            if size > 6 * BLOCK_WORDS:
                yield Block(runs, window, judge)
                runs, size = [], 0
    if runs:
        yield Block(runs, window, judge)


class Buckets:
    """Rows (bucket, document, mark, first word, words) that come bucket by bucket, settled in blocks of ``most`` bytes.

    Small buckets share a block.  One that is larger than a block is settled in parts: of what came before, its own
    surviving windows stay, and those of no other bucket.
    """

    def __init__(self, window: int, most: int) -> None:
        self.window, self.most = window, most
        self.waiting: list[tuple] = []
        self.size, self.bucket, self.opened, self.limit = 0, None, 0, most  # the bucket's rows stand from ``opened`` on

    def take(self, rows: Iterator[tuple]) -> Iterator[list[tuple]]:
        """What ``Block.removed`` tells of the blocks that more rows fill."""
        for key, doc, mark, first, words in rows:
            if key != self.bucket:
                if self.size > self.most:
                    yield self.rest()
                    self.waiting, self.size = [], 0
                self.bucket, self.opened, self.limit = key, len(self.waiting), self.most
            elif self.size > self.limit:
                block = Block(self.waiting[: self.opened] or self.waiting, self.window)
                yield list(block.removed())
                self.waiting = self.waiting[self.opened :] if self.opened else block.survivors()
                self.size = sum(len(r[3]) for r in self.waiting)
                if not self.opened:
                    self.limit = max(self.most, 2 * self.size)  # what survives is looked at again only once it has doubled
                self.opened = 0
            self.waiting.append((doc, mark, first, words))
            self.size += len(words)

    def rest(self) -> list[tuple]:
        """What it tells of the rows that wait."""
        return list(Block(self.waiting, self.window).removed())


def survey(rows: DataFrame, window: int, segments: int) -> tuple[np.ndarray, bytes]:
    """Triples that are the minimiser of more than one in ``FREQUENT`` strings (fewer than FREQUENT exist), and
    the filter of minimisers that two documents have.

    A triple with such a share overall has it in some block, so blocks report only those that do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        seen: list[np.ndarray] = []
        for block in _blocks(batches, window, judge=False):
            if not len(block.at):
                continue
            least = block._minimisers(np.zeros(0, np.uint64))
            firsts, _ = block._groups(~block.repeated, least)
            keys = least[np.searchsorted(block.at, firsts)]
            doc = block.doc[block.run_of[firsts]]
            order = np.lexsort((doc, keys))
            one = np.concatenate([[True], (keys[order][1:] != keys[order][:-1]) | (doc[order][1:] != doc[order][:-1])])
            seen.append(_mixed(keys[order][one]))
            keys, n = np.unique(keys, return_counts=True)
            often = n * FREQUENT > len(firsts)
            yield batch([(None, len(firsts), None, None, None), *((None, int(c), None, None, k) for k, c in zip(keys[often].view(np.int64).tolist(), n[often], strict=True))])
            if sum(map(len, seen)) > FLUSH:
                yield batch([(*row, None) for row in bloom.filled(np.concatenate(seen), segments)])
                seen = []
        if seen:
            yield batch([(*row, None) for row in bloom.filled(np.concatenate(seen), segments)])

    names = ["segment", "part", "once", "twice", "key"]
    found = materialize(rows.mapInArrow(run, "segment long, part long, once binary, twice binary, key long"))
    counts = found.where("segment IS NULL").groupBy("key").agg(F.sum("part").alias("n"))
    total = counts.where("key IS NULL").select("n").first()
    often = counts.where(F.col("key").isNotNull() & (F.col("n") * FREQUENT > (total[0] if total else 0))).select("key").toPandas()["key"]
    return np.sort(often.to_numpy(np.int64).view(np.uint64)), bloom.seen_twice(found.where("segment IS NOT NULL").select("segment", "part", "once", "twice"), segments)


def repeated_ranges(docs: DataFrame, key: str, text: str, window: int = 50, segments: int = 1024) -> DataFrame:
    """``doc, mark, first, end``: word ranges covered by windows that a smaller document starts too.

    ``mark`` is a hash of the whole text; it tells rows apart that repeat a key.
    """
    if window < GRAM:
        raise ValueError(f"a window has at least {GRAM} words")
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(key).alias("doc"), F.xxhash64(F.col(text).cast("string")).alias("mark"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["doc"].dataType.simpleString()
    shared = Shared(docs.sparkSession, survey(rows, window, segments))
    names = ["bucket", "doc", "mark", "first", "end", "words"]
    most = 6 * BLOCK_WORDS

    def batch(table: list[list], like: pa.DataType) -> pa.RecordBatch:
        types = [pa.int64(), like, pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(table, types, strict=True)], names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def noted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in source:
                kinds[:] = [b.schema.field(0).type]
                yield b

        for block in _blocks(noted(batches), window):
            out: list[list] = [[] for _ in names]
            for doc, mark, a, b in block.removed():  # settled here: it only needs to get home
                for c, v in zip(out, (mark + a, doc, mark, a, b, None), strict=True):
                    c.append(v)
            out[0] = [(x + (1 << 63)) % (1 << 64) - (1 << 63) for x in out[0]]
            frequent, twice = shared.get()
            for bucket, doc, mark, a, words in block.packed(frequent, np.frombuffer(twice, np.uint8)):
                for c, v in zip(out, (bucket, doc, mark, a, None, words), strict=True):
                    c.append(v)
            for lo in range(0, len(out[0]), 20_000):
                yield batch([c[lo : lo + 20_000] for c in out], kinds[0])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, kind_of = Buckets(window, most), None

        def answer(ranges: list[tuple]) -> pa.RecordBatch:
            docs_, marks, a, b = zip(*ranges, strict=True) if ranges else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(docs_, kind_of), pa.array(marks, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["doc", "mark", "first", "end"])

        for b in batches:
            kind_of = b.schema.field(1).type
            home = b.filter(b.column(4).is_valid())
            yield home.select(["doc", "mark", "first", "end"])
            rest = b.filter(b.column(5).is_valid())
            yield from map(answer, buckets.take(zip(*(rest.column(k).to_pylist() for k in (0, 1, 2, 3, 5)), strict=True)))
        if buckets.waiting:
            yield answer(buckets.rest())

    packed = rows.mapInArrow(pack, f"bucket long, doc {kind}, mark long, first long, end long, words binary")
    met = packed.repartition("bucket").sortWithinPartitions("bucket", "doc")
    return met.mapInArrow(settle, f"doc {kind}, mark long, first long, end long")


def dedup_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50, segments: int = 1024, counts: tuple[str, str] | None = ("n_words", "n_removed")) -> DataFrame:
    """All columns of the rows; ``text`` is its words without those that a repeated window covers, joined by blanks.

    Words are ``[^\\x20\\x09-\\x0D]+``.  A window of ``window`` words is repeated if its words also start in a
    document with a smaller ``key``; all windows are judged on the input.  A null text has no words and
    comes back empty.  Rows with a null ``key`` are no document and lose nothing.  Rows that repeat a key
    are one document and take nothing from each other.  ``segments`` (a power of two) bounds each filter to
    ``segments`` times 8 KiB; a larger one lets fewer strings travel in a larger corpus.  ``counts`` names columns for the numbers of
    words before and of words removed, which take the place of columns of these names; None leaves them out.
    """
    for c in (key, text):
        refuse(c, *(counts or ()))
    docs = without(docs, *(counts or ()))
    found = repeated_ranges(docs, key, text, window, segments)
    owner, mark, ranges = (fresh(docs.columns, x) for x in ("owner", "mark", "ranges"))
    lists = found.groupBy(F.col("doc").alias(owner), F.col("mark").alias(mark)).agg(F.collect_list(F.struct("first", "end")).alias(ranges))
    joined = docs.join(lists, (docs[key] == F.col(owner)) & (F.xxhash64(docs[text].cast("string")) == F.col(mark)), "left").drop(owner, mark)
    schema = widened(docs.schema, **dict.fromkeys(counts or (), "long"))
    place = docs.columns.index(text)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n, gone = [], [], []
            for body, spans in zip(texts(batch.column(place)), batch.column(batch.num_columns - 1), strict=True):
                words = body.split()
                n.append(len(words))
                if spans.is_valid:
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, spans.values.field(0).to_numpy(), 1)
                    np.add.at(change, spans.values.field(1).to_numpy(), -1)
                    covered = np.cumsum(change)[:-1] > 0
                    words = [words[k] for k in np.flatnonzero(~covered).tolist()]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(n, pa.int64()), pa.array(gone, pa.int64())] if counts else [])], names)

    return joined.mapInArrow(run, schema)

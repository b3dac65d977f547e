"""Best-fit packing of token sequences in bulk-synchronous rounds.

A round range-sorts the open pieces and the gaps of the open sequences by size, largest first.  Every
task sweeps its stretch: a piece goes to the smallest gap that holds it, and what is left of the gap
stays in play.  Pieces and gaps that stay over are ranked in their stretch; the numbers of each stretch
decide which ranks meet across stretches (the nearest larger stretch first, one piece for a gap), and a
join on the rank brings them together.  Gaps are updated, what is left opens new sequences in the next
round, and so on down the sizes.  The driver sees one row of counts for each stretch.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .common import Shared, fresh, refuse, slices
from .token_ids import WordIds

# Rows of one sweep, and bytes of text that a task tokenises at once.
SWEEP_ROWS = 200_000
SMALL, SPREAD = 32, 64
BLOCK_BYTES = 4 << 20
END = 0


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, ids: bool = False) -> DataFrame:
    """``key, piece, start, length, ids_crc32`` (and the ids): every row's ids and the end id 0, cut at ``capacity``.

    A null text is an empty one: a single piece with the end id.  Repeated rows give repeated pieces.
    """
    refuse(key, "piece", "start", "length", "ids_crc32", "ids")
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t"))
    shared = Shared(docs.sparkSession, tokenizer, WordIds)
    names = ["key", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.get()

        for batch in batches:
            bodies = batch.column(1)
            for lo, hi in slices(bodies, BLOCK_BYTES):
                out: list[list] = [[] for _ in names]
                for owner, found in enumerate(words.encode(bodies[lo:hi]), lo):
                    whole = np.append(found, np.uint32(END)).astype("<u4")
                    for piece, at in enumerate(range(0, len(whole), capacity)):
                        part = whole[at : at + capacity]
                        row = (owner, piece, at, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32))
                        for c, v in zip(out, row, strict=False):
                            c.append(v)
                kinds = [None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                rest = [pa.array(c, k) for c, k in zip(out[1:], kinds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out[0], pa.int64())), *rest], names)

    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if ids else "")
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def _sweeper(capacity: int, opens: bool):
    """Best fit over one stretch of ``size, kind, id, gap, fill`` (kind 0 a gap, 1 a piece), largest size first.

    A piece that no gap holds opens a sequence named after it, if the round ``opens`` any, or is left.
    Answers with pieces placed (kind 2: id, sequence, offset), pieces left (1) and gaps left (0); what is left
    has a rank, gaps that have become smaller than the stretch's sizes the rank -1.
    """

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps: dict[int, list[tuple[int, int]]] = {}
        mask, least, rank = 0, None, 0
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            kinds = [pa.int32(), *[pa.int64()] * 5]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["kind", "id", "size", "home", "at", "rank"])

        for rows in batches:
            for size, kind, ident, gap, fill in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                least = size
                if kind == 0:
                    gaps.setdefault(gap, []).append((ident, fill))
                    mask |= 1 << gap
                    continue
                fits = mask >> size
                if fits:
                    found = size + (fits & -fits).bit_length() - 1
                    home, at = gaps[found].pop()
                    if not gaps[found]:
                        mask ^= 1 << found
                elif opens:
                    found, home, at = capacity, ident, 0
                else:
                    out.append((1, ident, size, 0, 0, rank))
                    rank += 1
                    continue
                out.append((2, ident, size, home, at, -1))
                if found > size:
                    gaps.setdefault(found - size, []).append((home, at + size))
                    mask |= 1 << found - size
            if len(out) > 10_000:
                yield batch()
        rank = 0
        for gap in sorted(gaps):
            for home, at in gaps[gap]:
                fits_all = gap >= least
                out.append((0, home, gap, home, at, rank if fits_all else -1))
                rank += fits_all
        if out:
            yield batch()

    return sweep


def _meetings(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(stretch, first rank, number, other stretch, its first rank): which pieces left meet which gaps left.

    ``counts`` has stretch, pieces left and gaps left in the order of falling sizes.  Every gap of an
    earlier stretch holds every piece of a later one; the last gaps come first.
    """
    stack: list[list[int]] = []
    out = []
    for stretch, left, gaps in counts:
        rank = 0
        while rank < left and stack:
            other, first, n = stack[-1]
            take = min(n, left - rank)
            out.append((stretch, rank, take, other, first))
            rank += take
            if take == n:
                stack.pop()
            else:
                stack[-1] = [other, first + take, n - take]
        if gaps:
            stack.append([stretch, 0, gaps])
    return out


def _spread(sizes: dict[int, int]) -> list[int]:
    """Sizes at equal shares of the pieces' tokens, largest first."""
    own = sorted(sizes.items(), reverse=True)
    tokens, seen, out = sum(s * n for s, n in own), 0, []
    for s, n in own:
        seen += s * n
        out += [s] * (SPREAD * seen // tokens - len(out))
    return out


def best_fit(items: DataFrame, capacity: int = 2048) -> DataFrame:
    """``id, sequence_id, offset`` of items ``id`` (a unique long) with ``length`` of 1 to ``capacity``.

    Larger pieces come first, a halving of sizes at a time, so that small ones are left to fill gaps: a round
    matches them with the gaps there are, the next one opens sequences for those left.  What fits one
    stretch as a whole is swept at once.  A sequence is named after its first item.  Offsets follow each
    other without gaps from 0.  An empty table gives an empty table.
    """
    spark = items.sparkSession
    long = lambda x: F.lit(x).cast("long")
    placed = [items.where(F.col("length") == capacity).select("id", F.col("id").alias("sequence_id"), long(0).alias("offset"))]
    left = items.where(F.col("length") < capacity).select("id", F.col("length").cast("long").alias("size"))
    bins = spark.createDataFrame([], "id long, gap long, fill long")
    stuck = False
    while True:
        both = left.select(F.lit(1).alias("kind"), "size").union(bins.select(F.lit(0), "gap"))
        held = both.groupBy("kind", "size").count().collect()  # at most a row for each size
        sizes, gaps_of = ({r["size"]: r["count"] for r in held if r["kind"] == k} for k in (1, 0))
        if not sizes:
            break
        longest = max(sizes)
        whole = sum(sizes.values()) + sum(n for g, n in gaps_of.items() if g >= min(sizes)) <= SWEEP_ROWS
        floor = 0 if whole or longest <= capacity // SMALL else longest // 2
        tier = {s: n for s, n in sizes.items() if s > floor}
        least = min(tier)
        usable = sum(n for g, n in gaps_of.items() if g >= least)
        opens = whole or stuck or not usable
        stretches = max(1, math.ceil((sum(tier.values()) + usable) / SWEEP_ROWS))
        # a gap that holds any of the pieces may stand anywhere among them: where their tokens are
        spread = _spread(tier)
        anywhere = F.element_at(F.array(*map(long, spread)), F.pmod(F.xxhash64("id"), F.lit(len(spread))).cast("int") + 1)
        size = F.col("gap") if whole else F.when(F.col("gap") >= longest, anywhere).otherwise(F.col("gap"))
        events = (
            left.where(F.col("size") > floor)
            .select("size", F.lit(1).alias("kind"), "id", long(0).alias("gap"), long(0).alias("fill"))
            .union(bins.where(F.col("gap") >= least).select(size.alias("size"), F.lit(0).alias("kind"), "id", "gap", "fill"))
            .withColumn("slot", F.pmod(F.xxhash64("id", "kind"), F.lit(stretches)))
        )
        order = [F.desc("size"), F.asc("slot"), F.asc("kind"), F.asc("id")]
        dealt = events.repartitionByRange(stretches, *order).sortWithinPartitions(*order).drop("slot")
        swept = dealt.mapInArrow(_sweeper(capacity, opens), "kind int, id long, size long, home long, at long, rank long")
        swept = materialize(swept.withColumn("stretch", F.spark_partition_id()))
        placed.append(swept.where("kind = 2").select("id", F.col("home").alias("sequence_id"), F.col("at").alias("offset")))
        if whole:
            break
        later = left.where(F.col("size") <= floor)
        gaps = swept.where("kind = 0").select(F.col("id").alias("home"), F.col("size").alias("gap"), F.col("at").alias("fill"), "stretch", "rank")
        smaller = bins.where(F.col("gap") < least)
        if opens:  # nothing of the tier is left
            left, stuck = later, False
            bins = materialize(gaps.select(F.col("home").alias("id"), "gap", "fill").union(smaller))
            continue
        counts = swept.where("rank >= 0").groupBy("stretch").agg(F.sum((F.col("kind") == 1).cast("long")).alias("p"), F.sum((F.col("kind") == 0).cast("long")).alias("g"))
        told = [tuple(r) for r in counts.orderBy("stretch").collect()]
        meetings = _meetings(told)
        stuck = sum(p for _, p, _ in told) > sum(n for _, _, n, _, _ in meetings)
        pieces_left = swept.where("kind = 1")
        plan = spark.createDataFrame(meetings, "stretch int, first long, n long, other int, other_first long")
        planned = pieces_left.join(F.broadcast(plan), (pieces_left["stretch"] == plan["stretch"]) & F.col("rank").between(F.col("first"), F.col("first") + F.col("n") - 1), "left")
        planned = planned.select("id", "size", F.col("other").alias("stretch"), (F.col("rank") - F.col("first") + F.col("other_first")).alias("rank"))
        met = materialize(gaps.where("rank >= 0").join(planned.where("stretch IS NOT NULL"), ["stretch", "rank"], "left").select("id", "size", "home", "gap", "fill"))
        placed.append(met.where("id IS NOT NULL").select("id", F.col("home").alias("sequence_id"), F.col("fill").alias("offset")))
        left = materialize(planned.where("stretch IS NULL").select("id", "size").union(later))
        used = F.coalesce("size", F.lit(0))
        after = met.select(F.col("home").alias("id"), (F.col("gap") - used).alias("gap"), (F.col("fill") + used).alias("fill"))
        after = after.union(gaps.where("rank < 0").select(F.col("home").alias("id"), "gap", "fill"))
        bins = materialize(after.union(smaller).where("gap > 0"))
    out = placed[0]
    for more_placed in placed[1:]:
        out = out.union(more_placed)
    return out


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, ids: bool = False) -> DataFrame:
    """Every piece of every row with its ``sequence_id`` and ``offset``; ``key`` may not have the name of a result column."""
    refuse(key, "sequence_id", "offset")
    number = fresh([key], "id")
    cut = materialize(pieces(docs, tokenizer, key, text, capacity, ids).withColumn(number, F.monotonically_increasing_id()))
    placed = best_fit(cut.select(F.col(number).alias("id"), "length"), capacity).withColumnRenamed("id", number)
    return cut.join(placed, number).drop(number)

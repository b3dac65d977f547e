"""Ordered computations over long series that do not put a series into one task.

A plain ``Window.partitionBy(subject).orderBy(t)`` hands a whole recording to one task; a recording
that holds a third of all rows then decides the running time.  ``scan`` splits every series into
time chunks instead: each chunk is ordered on its own, one summary row per chunk is carried across
chunk borders, and an equi-join on (series, chunk) brings the carried state back to the rows.  The
rows are shuffled once, on the chunk key.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from physio_spark.runtime import ROWS_PER_CHUNK, materialize

CHUNK = "_chunk"
_FOLDS = {"sum": F.sum, "min": F.min, "max": F.max}


def chunk_of(t: str, width: int) -> Column:
    return F.floor(F.col(t) / F.lit(width))


def chunk_width(
    df: DataFrame,
    by: Sequence[str],
    t: str,
    start: int,
    target: int = ROWS_PER_CHUNK,
) -> int:
    """Widest chunk, at most ``start``, with no more than ``target`` rows of a series in any chunk.

    The bound is measured, not assumed: every round counts the fullest chunk (one partially
    aggregated pass over the key columns) and narrows the width until it fits.  A burst on a single
    time value cannot be split by time; the width then stops at 1.
    """
    width = int(start)
    while True:
        fullest = (
            df.groupBy(*by, chunk_of(t, width).alias(CHUNK)).count().agg(F.max("count")).first()[0]
        )
        if fullest is None or fullest <= target or width <= 1:
            return width
        width = max(1, int(math.floor(width * target / fullest * 0.9)))


def scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    width: int,
    *,
    prev: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    ahead: Mapping[str, Column] | None = None,
    running: Mapping[str, Column] | None = None,
    index: str | None = None,
    whole: Mapping[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Add order-dependent columns to every row of every series.

    prev / following : value of the expression in the row before / after (null at the ends)
    last             : last non-null value at or before the row
    ahead            : first non-null value at or after the row
    running          : running sum up to and including the row
    index            : zero-based position in the series
    whole            : ("sum" | "min" | "max", expression) folded over the whole series

    ``order`` starts with the numeric column the chunks are cut on, followed by tie-breakers.
    """
    prev, following, last = dict(prev or {}), dict(following or {}), dict(last or {})
    ahead, running, whole = dict(ahead or {}), dict(running or {}), dict(whole or {})
    by = list(by)
    keys = by + [CHUNK]
    columns = df.columns
    d = df.withColumn(CHUNK, chunk_of(order[0], width))

    rank = F.struct(*order)
    up = Window.partitionBy(*keys).orderBy(*order)
    down = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    to_here = (Window.unboundedPreceding, Window.currentRow)

    local: list[Column] = []
    summary: list[Column] = []
    carried: list[Column] = []
    result: list[Column] = []
    chunks_up = Window.partitionBy(*by).orderBy(CHUNK)
    chunks_down = Window.partitionBy(*by).orderBy(F.desc(CHUNK))
    before = (Window.unboundedPreceding, -1)

    def state(name: str, here: Column, fold: Column, carry: Column, merge) -> None:
        local.append(here.alias(f"_l_{name}"))
        summary.append(fold.alias(f"_s_{name}"))
        carried.append(carry.alias(f"_c_{name}"))
        result.append(merge(F.col(f"_l_{name}"), F.col(f"_c_{name}")).alias(name))

    for name, e in prev.items():
        boxed = F.struct(e.alias("v"))
        state(
            name,
            F.lag(boxed).over(up),
            F.max_by(boxed, rank),
            F.lag(f"_s_{name}").over(chunks_up),
            lambda here, there: F.coalesce(here, there)["v"],
        )
    for name, e in following.items():
        boxed = F.struct(e.alias("v"))
        state(
            name,
            F.lead(boxed).over(up),
            F.min_by(boxed, rank),
            F.lead(f"_s_{name}").over(chunks_up),
            lambda here, there: F.coalesce(here, there)["v"],
        )
    for name, e in last.items():
        state(
            name,
            F.last(e, ignorenulls=True).over(up.rowsBetween(*to_here)),
            F.max_by(e, F.when(e.isNotNull(), rank)),
            F.last(f"_s_{name}", ignorenulls=True).over(chunks_up.rowsBetween(*before)),
            lambda here, there: F.coalesce(here, there),
        )
    for name, e in ahead.items():
        state(
            name,
            F.last(e, ignorenulls=True).over(down.rowsBetween(*to_here)),
            F.min_by(e, F.when(e.isNotNull(), rank)),
            F.last(f"_s_{name}", ignorenulls=True).over(chunks_down.rowsBetween(*before)),
            lambda here, there: F.coalesce(here, there),
        )
    for name, e in running.items():
        state(
            name,
            F.sum(e).over(up.rowsBetween(*to_here)),
            F.sum(e),
            F.sum(f"_s_{name}").over(chunks_up.rowsBetween(*before)),
            lambda here, there: F.coalesce(here, F.lit(0)) + F.coalesce(there, F.lit(0)),
        )
    if index:
        state(
            index,
            F.row_number().over(up) - 1,
            F.count(F.lit(1)),
            F.sum(f"_s_{index}").over(chunks_up.rowsBetween(*before)),
            lambda here, there: here + F.coalesce(there, F.lit(0)),
        )
    for name, (fold, e) in whole.items():
        summary.append(_FOLDS[fold](e).alias(f"_s_{name}"))
        carried.append(_FOLDS[fold](f"_s_{name}").over(Window.partitionBy(*by)).alias(f"_c_{name}"))
        result.append(F.col(f"_c_{name}").alias(name))

    rows = d.select("*", *local) if local else d
    state_table = d.groupBy(*keys).agg(*summary).select(*keys, *carried)
    return same_keys(rows, state_table, keys, "left").select(*columns, *result)


def same_keys(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on keys of which nulls equal each other; the keys come from ``df``."""
    other = {k: f"_key_{i}" for i, k in enumerate(keys)}
    renamed = table.withColumnsRenamed(other)
    same = [df[k].eqNullSafe(renamed[o]) for k, o in other.items()]
    return df.join(renamed, reduce(lambda a, b: a & b, same), how).drop(*other.values())


def attach(df: DataFrame, table: DataFrame, by: Sequence[str], salts: int = 1, how: str = "inner") -> DataFrame:
    """Join one row per group back to the rows of the group; a null key is a group like any other.

    With ``salts`` > 1 the group key is salted, so the rows of a hot group are spread over that many
    tasks; the per-group table is repeated once per salt.  Small tables are broadcast by Spark's own
    size check, never by force.
    """
    by = list(by)
    if not by:
        return df.crossJoin(table)  # the table is a single aggregate row
    if salts <= 1:
        return same_keys(df, table, by, how)
    plain = [c for c, kind in df.dtypes if not kind.startswith("map")]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)))
    spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return same_keys(salted, spread, by + ["_salt"], how).drop("_salt")


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Zero-based position of each row of the whole frame in a total order: one shuffle by ranges.

    The rows are written with their place in their range; the sizes of the ranges (a row for each task) give
    the offsets.
    """
    placed = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.select(*df.columns, F.shiftright("_at", 33).alias("_range"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(sizes), "_range").select(*df.columns, (F.col("_before") + F.col("_place")).alias(name))


DIGITS = 4  # hexadecimal digits that one pass of ``smallest`` counts: 65 536 bins


def smallest(df: DataFrame, by: Sequence[str], h: Column, n: int, tie: Sequence[str] = (), name: str = "_chosen") -> DataFrame:
    """Add whether a row is among the ``n`` of its group with the smallest hash ``h`` (hexadecimal, at least 8 digits).

    Radix selection: a histogram of the first digits tells in which bin the n-th hash lies, a second one of the
    next digits in that bin alone.  All other rows are decided by comparing digits; only rows that share 32 bits
    with the n-th are put in order (by hash, then ``tie``).
    """
    by = list(by)
    d = df.withColumn("_sel_h", h)
    digit = lambda i: F.substring("_sel_h", 1 + i * DIGITS, DIGITS)

    def cut(rows: DataFrame, i: int, need: Column) -> DataFrame:
        """Per group the bin that holds the last row wanted, and how many of its rows are."""
        bins = rows.groupBy(*by, digit(i).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"), F.max(need).alias("_need"))
        up = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        reached = bins.withColumn("_upto", F.sum("_n").over(up)).where(F.col("_upto") >= F.col("_need"))
        first = F.min(F.struct(F.col("_bin"), (F.col("_need") - F.col("_upto") + F.col("_n")).alias("left")))
        return reached.groupBy(*by).agg(first.alias("_cut")).select(*by, F.col("_cut._bin").alias(f"_bin{i}"), F.col("_cut.left").alias(f"_left{i}"))

    first = materialize(cut(d, 0, F.lit(n)))
    salts = 16 if by else 1
    in_bin = attach(d, first, by, salts).where(digit(0) == F.col("_bin0"))
    cuts = same_keys(first, cut(in_bin, 1, F.col("_left0")), by, "left") if by else first.join(cut(in_bin, 1, F.col("_left0")), how="left")
    cuts = materialize(cuts)
    if by:
        placed = attach(d, cuts, by, salts, "left")  # a group without a cut has at most n rows
    else:
        placed = d.join(F.broadcast(cuts), how="left")  # at most one row
    edge = F.coalesce((digit(0) == F.col("_bin0")) & (digit(1) == F.col("_bin1")), F.lit(False))
    below = F.col("_bin0").isNull() | (digit(0) < F.col("_bin0")) | ((digit(0) == F.col("_bin0")) & (digit(1) < F.col("_bin1")))
    sure = placed.where(~edge).withColumn(name, below)
    order = Window.partitionBy(*by).orderBy("_sel_h", *tie)
    close = placed.where(edge).withColumn(name, F.row_number().over(order) <= F.col("_left1"))
    return sure.select(*df.columns, name).unionByName(close.select(*df.columns, name))


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str, spread: Column, salts: int = 64) -> DataFrame:
    """One-based position of each row in its group, for groups too large for one task.

    ``spread`` is a non-negative integer that grows with ``order``; it is what the groups are cut on.
    """
    by = list(by)
    d = df.withColumn(CHUNK, spread)
    w = Window.partitionBy(*by, CHUNK).orderBy(*order)
    offsets = (
        d.groupBy(*by, CHUNK)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_n").over(Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .drop("_n")
    )
    return (
        same_keys(d.withColumn("_r", F.row_number().over(w)), offsets, by + [CHUNK], "inner")
        .withColumn(name, F.col("_r") + F.col("_before"))
        .drop(CHUNK, "_r", "_before")
    )

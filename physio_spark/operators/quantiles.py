"""Exact quantiles and modes of groups of any size."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from physio_spark.functions.columns import col, finite
from physio_spark.operators.ordered import attach, same_keys
from physio_spark.runtime import ROWS_PER_CHUNK, materialize


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Row count of the fullest group (one partially aggregated pass)."""
    if not by:
        return df.count()
    return df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


# Up to this many intervals (of all groups) are sent to every task; more are joined by a shuffle.
BROADCAST_EDGES = 50_000

# Above this group size the values of a group are no longer gathered by the built-in percentile.
GATHER_ROWS = 100_000


def percentile_columns(specs: Mapping[str, tuple[str | Column, float]]) -> tuple[list[Column], list[Column]]:
    """Aggregates and result columns for groups of bounded size.

    Quantiles of the same column share one aggregate, so its values are gathered once.
    """
    groups: dict = {}
    for name, (c, p) in specs.items():
        groups.setdefault(c if isinstance(c, str) else id(c), (c, []))[1].append((name, p))
    aggs, outs = [], []
    for i, (c, wanted) in enumerate(groups.values()):
        aggs.append(F.percentile(finite(c), F.array(*[F.lit(float(p)) for _, p in wanted])).alias(f"_pct{i}"))
        outs += [F.get(F.col(f"_pct{i}"), F.lit(j)).alias(name) for j, (name, _) in enumerate(wanted)]
    return aggs, outs


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    specs: Mapping[str, tuple[str | Column, float]],
    max_rows: int | None = GATHER_ROWS,
) -> DataFrame:
    """Exact linear-interpolation quantiles: ``{output name: (column, probability)}``.

    Groups whose measured size stays within ``max_rows`` use the built-in ``percentile``; otherwise
    every group goes through :func:`bracketed_quantiles`.  ``max_rows=None`` states that the caller
    knows the groups to be bounded (for instance by window length times sampling rate).
    """
    if max_rows is not None:
        fullest = largest_group(df, by)
        if fullest > max_rows:
            return bracketed_quantiles(df, by, specs, resolution_for(fullest))
    aggs, outs = percentile_columns(specs)
    return df.groupBy(*by).agg(*aggs).select(*by, *outs)


def resolution_for(rows: int) -> int:
    """Sketch resolution that leaves at most about ROWS_PER_CHUNK values inside an interval."""
    return max(10_000, -(-4 * rows // ROWS_PER_CHUNK))


def bracketed_quantiles(
    df: DataFrame,
    by: Sequence[str],
    specs: Mapping[str, tuple[str | Column, float]],
    accuracy: int = 10_000,
) -> DataFrame:
    """Exact quantiles without gathering a group.

    A mergeable sketch first gives, per group and quantile, an interval that is guaranteed to hold the
    wanted order statistics.  Rows outside every interval are only counted per gap between the
    intervals; just the few distinct values inside the interval of a wanted rank are put in order.
    """
    by = list(by)
    columns: dict = {}
    for name, (c, p) in specs.items():
        columns.setdefault(c if isinstance(c, str) else id(c), (c, []))[1].append((name, p))
    # the columns stand under each other: two passes over the rows, whatever their number
    stacked = df.select(*by, F.inline(F.array(*[F.struct(F.lit(i).alias("_col"), finite(c).alias("_x")) for i, (c, _) in enumerate(columns.values())])))
    probs = sorted({p for _, p in specs.values()})
    found = _bracketed_column(stacked, [*by, "_col"], probs, accuracy)
    whole = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_col", "_q"))).alias("_q"))  # a row for each column
    outs = {name: F.get(F.try_element_at("_q", F.lit(i)), F.lit(probs.index(p))).alias(name) for i, (_, own) in enumerate(columns.values()) for name, p in own}
    return whole.select(*by, *[outs[name] for name in specs])


def _bracketed_column(rows: DataFrame, by: list[str], probs: list[float], accuracy: int, salts: int = 16) -> DataFrame:
    """``_q``, the quantiles of ``_x``, for every group."""
    margin, count = 2.0 / accuracy, len(probs)
    borders = [q for p in probs for q in (max(0.0, p - margin), min(1.0, p + margin))]
    edges = rows.groupBy(*by).agg(
        F.count("_x").alias("_n"), F.percentile_approx("_x", borders, accuracy).alias("_edge")
    )
    # A group no larger than the sketch resolution is short enough to be ordered in full.
    open_ = F.flatten(F.array_repeat(F.array(F.lit(-math.inf), F.lit(math.inf)), count))
    edges = edges.withColumn("_edge", F.when(F.col("_n") <= accuracy, open_).otherwise(F.col("_edge")))
    between = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.struct(F.get("_edge", 2 * i).alias("a"), F.get("_edge", 2 * i + 1).alias("z")))
    last, place = F.col("_n") - 1, F.array(*map(F.lit, map(float, probs)))
    low_rank = F.transform(place, lambda p: F.floor(p * last))
    high_rank = F.transform(place, lambda p: F.least(F.floor(p * last) + 1, last))
    share = F.transform(place, lambda p: p * last - F.floor(p * last))
    edges = edges.select(
        *by, F.array_sort("_edge").alias("_cuts"), between.alias("_between"), F.array_distinct(F.concat(low_rank, high_rank)).alias("_ranks"),
        low_rank.alias("_low"), high_rank.alias("_high"), share.alias("_share"),
    )
    # whether the values just above a cut are in an interval
    covered = F.transform("_cuts", lambda c: F.exists("_between", lambda b: (b["a"] <= c) & (c < b["z"])))
    edges = materialize(edges.withColumn("_covered", covered).drop("_between"))
    x = F.col("_x")
    table, known = edges.select(*by, "_cuts", "_covered"), rows.where(x.isNotNull())
    if edges.count() * count <= BROADCAST_EDGES:
        joined = same_keys(known, F.broadcast(table), by, "inner")  # the rows stay where they are
    else:
        joined = attach(known, table, by, salts)
    inside = (x == F.get("_cuts", F.col("_gap") - 1)) | F.coalesce(F.get("_covered", F.col("_gap") - 1), F.lit(False))
    counted = joined.withColumn("_gap", _cuts_upto(x, 0, 2 * count)).groupBy(*by, "_gap", F.when(inside, x).alias("_x"))
    counted = materialize(counted.agg(F.count(F.lit(1)).alias("_m")))
    # Only the gaps that hold a wanted rank are put in order, each on its own.
    earlier = Window.partitionBy(*by).orderBy("_gap").rowsBetween(Window.unboundedPreceding, -1)
    gaps = counted.groupBy(*by, "_gap").agg(F.sum("_m").alias("_all"))
    gaps = gaps.withColumn("_before", F.coalesce(F.sum("_all").over(earlier), F.lit(0)))
    here = F.filter("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_all")))
    gaps = same_keys(gaps, edges.select(*by, "_ranks"), by, "inner").withColumn("_wanted", here).where(F.size("_wanted") > 0)
    hit = same_keys(counted.where(x.isNotNull()), gaps.select(*by, "_gap", "_before", "_wanted"), [*by, "_gap"], "inner")
    upto = F.col("_before") + F.sum("_m").over(Window.partitionBy(*by, "_gap").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    own = F.filter("_wanted", lambda r: (r >= F.col("_upto") - F.col("_m")) & (r < F.col("_upto")))
    found = hit.withColumn("_upto", upto).select(*by, x, F.explode(own).alias("_rank"))
    values = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_values"))
    at = lambda ranks: F.transform(ranks, lambda r: F.try_element_at("_values", r))
    told = same_keys(edges, values, by, "left").select(*by, "_share", at("_low").alias("_a"), at("_high").alias("_b"))
    q = F.transform(F.arrays_zip("_a", "_b", "_share"), lambda z: z["_a"] + z["_share"] * (z["_b"] - z["_a"]))
    return told.select(*by, q.alias("_q"))


def _cuts_upto(x: Column, least: int, most: int) -> Column:
    """How many of the sorted ``_cuts`` are at most ``x``: a search by halves, whose depth is a logarithm of their number."""
    if least == most:
        return F.lit(least)
    mid = (least + most) // 2
    return F.when(x >= F.get("_cuts", F.lit(mid)), _cuts_upto(x, mid + 1, most)).otherwise(_cuts_upto(x, least, mid))


def mode_of(df: DataFrame, by: Sequence[str], value: str, name: str, default=None) -> DataFrame:
    """Most frequent non-null value per group; ties go to the smallest (alphabetically first) value.

    Values are counted first, so a group shrinks to its distinct values before it is gathered.
    """
    v = col(value)
    counted = df.groupBy(*by, value).agg(F.count(v).alias("_n"))
    rank = F.when(v.isNotNull(), F.struct(-F.col("_n"), v))
    picked = counted.groupBy(*by).agg(F.min_by(v, rank).alias(name))
    if default is not None:
        picked = picked.withColumn(name, F.coalesce(F.col(name), F.lit(default)))
    return picked

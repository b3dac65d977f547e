"""Descriptive statistics of windows and groups, one partially aggregated pass per request.

Statistics that look at neighbouring samples read ``prev_<c>`` / ``next_<c>`` / ``idx`` columns that
:func:`with_neighbours` computes once per block, before the windows are exploded; inside a window
they are ordinary filtered aggregates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from physio_spark.functions.columns import finite
from physio_spark.operators.ordered import attach, scan
from physio_spark.operators.quantiles import (
    GATHER_ROWS,
    bracketed_quantiles,
    largest_group,
    percentile_columns,
    quantiles,
    resolution_for,
)

BASE = ("mean", "std0", "min", "max", "slope")
EXTENDED = ("mean", "std1", "min", "max", "median", "iqr", "range", "slope")
BASIC_BLOCK = ("min", "max", "mean", "std0", "median", "range", "skew", "kurtosis")
DIFFERENCES = ("diff_mean", "diff_std0", "diff_positive")
# Statistics that read the columns of with_neighbours, and those that read the rows more than once.
NEEDS_NEIGHBOURS = {
    "slope_fs", "slope_fit", "auc", "diff_mean", "diff_std0", "diff_std1", "diff_positive", "breath_rate", "zero_crossings",
}
SEVERAL_PASSES = {"median", "iqr", "q25", "q75", "mad", "zero_crossings"}
ZERO_WHEN_EMPTY = {
    "mean", "std0", "std1", "min", "max", "median", "iqr", "range", "slope", "slope_fs",
    "diff_mean", "diff_std0", "diff_std1", "diff_positive", "zero_crossings", "breath_rate",
}


def with_neighbours(
    df: DataFrame,
    by: Sequence[str],
    cols: Sequence[str],
    t: str = "t",
    *,
    width: int,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Add ``idx``, ``prev_t``, ``next_t``, ``prev_<c>`` and ``next_<c>`` inside every block."""
    names = [t, *[c for c in cols if c != t]]
    return scan(
        df,
        by,
        [t, *tie],
        width,
        index="idx",
        prev={f"prev_{c}": F.col(c) for c in names},
        following={f"next_{c}": F.col(c) for c in names},
    )


def skewness(c: Column) -> Column:
    """Population skewness: null below three values, 0 for a constant."""
    n = F.count(c)
    return F.when(n < 3, F.lit(None)).otherwise(F.coalesce(F.skewness(c), F.lit(0.0)))


def excess_kurtosis(c: Column) -> Column:
    """Population excess kurtosis: null below four values, -3 for a constant."""
    n = F.count(c)
    return F.when(n < 4, F.lit(None)).otherwise(F.coalesce(F.kurtosis(c), F.lit(-3.0)))


def least_squares_slope(y: Column, x: Column, min_rows: int = 3) -> Column:
    """Slope of the fitted line; null below ``min_rows`` values."""
    return F.when(F.count(y) >= min_rows, F.coalesce(F.regr_slope(y, x), F.lit(0.0)))


def _aggregate(name: str, c: str, ctx: Mapping) -> Column:
    y = finite(c)
    n = F.count(y)
    fs, inside_prev, inside_next = ctx["fs"], ctx["inside_prev"], ctx["inside_next"]
    idx = F.col("idx")
    before, after = finite(f"prev_{c}"), finite(f"next_{c}")
    step = F.when(inside_prev, (y - before) * fs)
    if name == "n":
        return n
    if name == "mean":
        return F.avg(y)
    if name == "std0":
        return F.stddev_pop(y)
    if name == "std1":
        return F.when(n < 2, F.lit(0.0)).otherwise(F.stddev_samp(y))
    if name == "min":
        return F.min(y)
    if name == "max":
        return F.max(y)
    if name == "range":
        return F.max(y) - F.min(y)
    if name == "slope":
        return F.coalesce(F.regr_slope(y, ctx["elapsed"] / F.lit(ctx["unit"])), F.lit(0.0))
    if name == "slope_fs":
        return F.coalesce(F.regr_slope(y, idx) * F.max(fs), F.lit(0.0))
    if name == "slope_fit":
        return least_squares_slope(y, idx)
    if name == "skew":
        return skewness(y)
    if name == "kurtosis":
        return excess_kurtosis(y)
    if name == "auc":
        return F.coalesce(F.sum(F.when(inside_prev, (y + before) / 2 / fs)), F.lit(0.0))
    if name == "diff_mean":
        return F.avg(step)
    if name == "diff_std0":
        return F.stddev_pop(step)
    if name == "diff_std1":
        return F.when(F.count(step) < 2, F.lit(0.0)).otherwise(F.stddev_samp(step))
    if name == "diff_positive":
        return F.avg((step > 0).cast("int"))
    if name == "breath_rate":
        turn = inside_prev & inside_next & (y - before > 0) & (after - y <= 0)
        minutes = F.greatest(n / F.max(fs), F.lit(1e-6)) / 60.0
        return F.when(n < 3, F.lit(0.0)).otherwise(F.sum(F.when(turn, 1).otherwise(0)) / minutes)
    raise ValueError(f"unknown statistic {name!r}")


QUANTILE_NAMES = {"median": (0.5,), "iqr": (0.25, 0.75), "q25": (0.25,), "q75": (0.75,)}
_SECOND_PASS = ("zero_crossings", "mad")


def stats(
    df: DataFrame,
    by: Sequence[str],
    cols: Sequence[str],
    spec: Sequence[str] = BASE,
    t: str = "t",
    *,
    fs: float | Column = 1.0,
    window: tuple[str, str] | None = None,
    unit: float = 1e6,
    max_rows: int | None = GATHER_ROWS,
    empty: float | None = 0.0,
) -> DataFrame:
    """Per-group statistics ``<c>_<name>`` for every column and every name in ``spec``.

    ``window=(start, end)`` names the bounds of the group, so that a neighbour outside it is ignored;
    without it the neighbours of the block are used as they are.  ``slope`` is per second of ``t``
    (``unit`` parts per second), ``slope_fs`` per sample index times ``fs``.  An empty group gives
    ``empty`` for the statistics that have a zero default.
    """
    by = list(by)
    spec = list(spec)
    if window:
        inside_prev = F.col(f"prev_{t}") >= F.col(window[0])
        inside_next = F.col(f"next_{t}") < F.col(window[1])
    else:
        inside_prev, inside_next = F.lit(True), F.lit(True)
    fs = fs if isinstance(fs, Column) else F.lit(float(fs))
    # The rate is one number per group; inside row expressions it is a plain column.
    # Time since the window began: large time stamps would cost the slope its digits.
    elapsed = F.col(t) - F.col(window[0]) if window else F.col(t)
    ctx = {"fs": fs, "elapsed": elapsed, "bounded": window is not None, "t": t, "unit": unit, "inside_prev": inside_prev, "inside_next": inside_next}
    direct = [s for s in spec if s not in QUANTILE_NAMES and s not in _SECOND_PASS]
    second = [s for s in spec if s in _SECOND_PASS]
    quantile = [s for s in spec if s in QUANTILE_NAMES]

    aggs = [_aggregate(s, c, ctx).alias(f"{c}_{s}") for c in cols for s in direct]
    if "zero_crossings" in second:
        aggs += [F.avg(finite(c)).alias(f"_m_{c}") for c in cols]
    aggs.append(F.count(F.lit(1)).alias("n_rows"))
    wanted = {}
    for c in cols:
        if "mad" in second:
            wanted[f"_med_{c}"] = (c, 0.5)
        for s in quantile:
            for p in QUANTILE_NAMES[s]:
                wanted[f"_{s}{round(100 * p)}_{c}"] = (c, p)  # a dot in a name would be read as a field
    fullest = largest_group(df, by) if wanted and max_rows is not None else 0
    if wanted and fullest <= (max_rows or 0):
        gathered, placed = percentile_columns(wanted)
        out = df.groupBy(*by).agg(*aggs, *gathered).select("*", *placed)
    else:
        out = df.groupBy(*by).agg(*aggs)
        if wanted:
            q = bracketed_quantiles(df, by, wanted, resolution_for(fullest))
            out = out.join(q, by) if by else out.crossJoin(q)  # without groups both are single rows
    if wanted:
        for c in cols:
            for s in quantile:
                ps = QUANTILE_NAMES[s]
                v = F.col(f"_{s}{round(100 * ps[-1])}_{c}")
                out = out.withColumn(f"{c}_{s}", v - F.col(f"_{s}{round(100 * ps[0])}_{c}") if len(ps) == 2 else v)
    if second:
        out = _second_pass(df, out, by, cols, second, ctx, max_rows)
    if empty is not None:
        for c in cols:
            for s in spec:
                if s in ZERO_WHEN_EMPTY:
                    out = out.withColumn(f"{c}_{s}", F.coalesce(F.col(f"{c}_{s}"), F.lit(float(empty))))
    return out.select(*by, "n_rows", *[f"{c}_{s}" for c in cols for s in spec])


def _second_pass(df, out, by, cols, second, ctx, max_rows):
    """Statistics about a centre that the first pass produced."""
    extra = [f"_m_{c}" for c in cols if "zero_crossings" in second]
    extra += [f"_med_{c}" for c in cols if "mad" in second]
    # Windows are short; groups without bounds may be hot and are salted.
    centred = attach(df, out.select(*by, *extra), by, salts=1 if ctx["bounded"] else 16)
    if "zero_crossings" in second:
        crossings = []
        for c in cols:
            y, before, m = finite(c), finite(f"prev_{c}"), F.col(f"_m_{c}")
            flips = ctx["inside_prev"] & ((y - m < 0) != (before - m < 0))
            seconds = F.greatest(F.count(y) / F.greatest(F.max(ctx["fs"]), F.lit(1e-6)), F.lit(1e-6))
            crossings.append((F.sum(F.when(flips, 1).otherwise(0)) / seconds).alias(f"{c}_zero_crossings"))
        out = out.join(centred.groupBy(*by).agg(*crossings), by)
    if "mad" in second:
        spread = {f"{c}_mad": (F.abs(finite(c) - F.col(f"_med_{c}")), 0.5) for c in cols}
        out = out.join(quantiles(centred, by, spread, max_rows), by)
    return out


def subject_video_features(
    df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("subject", "video"), spec: Sequence[str] = BASIC_BLOCK
) -> DataFrame:
    """Feature table with one row per subject and stimulus."""
    return stats(df, by, cols, spec, empty=None)


def two_level_mean(df: DataFrame, cols: Sequence[str], inner: Sequence[str], outer: Sequence[str]) -> DataFrame:
    """Mean of the group means: every inner group counts once, whatever its size."""
    means = df.groupBy(*dict.fromkeys([*inner, *outer])).agg(*[F.avg(finite(c)).alias(c) for c in cols])
    return means.groupBy(*outer).agg(*[F.avg(c).alias(c) for c in cols], F.count(F.lit(1)).alias("n_groups"))


def category_summary(
    df: DataFrame, by: Sequence[str], cols: Sequence[str], max_rows: int | None = GATHER_ROWS
) -> DataFrame:
    """Mean, std (ddof 1) and box-plot numbers per category; whiskers are the most extreme values
    within 1.5 interquartile ranges of the box."""
    by = list(by)
    wanted = {f"{c}_{n}": (c, p) for c in cols for n, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))}
    q = quantiles(df, by, wanted, max_rows)
    aggs = []
    for c in cols:
        reach = 1.5 * (F.col(f"{c}_q75") - F.col(f"{c}_q25"))
        y = finite(c)
        aggs += [
            F.avg(y).alias(f"{c}_mean"),
            F.stddev_samp(y).alias(f"{c}_std"),
            F.min(F.when(y >= F.col(f"{c}_q25") - reach, y)).alias(f"{c}_low"),
            F.max(F.when(y <= F.col(f"{c}_q75") + reach, y)).alias(f"{c}_high"),
            *[F.first(f"{c}_{n}").alias(f"{c}_{n}") for n in ("q25", "median", "q75")],
        ]
    return attach(df.select(*by, *cols), q, by, salts=32).groupBy(*by).agg(*aggs)


def minmax_profile(
    table: DataFrame, cols: Sequence[str], flat_to_zero: bool = True
) -> DataFrame:
    """Scale every column of a small per-stimulus table to [0, 1]; a column without range becomes 0."""
    ends = table.agg(*[F.min(c).alias(f"_lo_{c}") for c in cols], *[F.max(c).alias(f"_hi_{c}") for c in cols])
    out = table.join(F.broadcast(ends))  # one aggregate row
    for c in cols:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        scaled = (F.col(c) - lo) / (hi - lo + F.lit(1e-12))
        if flat_to_zero:
            scaled = F.when(hi == lo, F.lit(0.0)).otherwise(F.coalesce(scaled, F.lit(0.0)))
        out = out.withColumn(c, scaled)
    return out.select(*table.columns)


def top_variance(table: DataFrame, cols: Sequence[str], k: int = 3) -> DataFrame:
    """The ``k`` columns that vary most over the rows (variance with ddof 1)."""
    spread = table.agg(*[F.var_samp(finite(c)).alias(c) for c in cols])
    long = spread.unpivot([], list(cols), "feature", "variance")
    return long.orderBy(F.desc_nulls_last("variance"), "feature").limit(k)


def mean_curve(
    curves: DataFrame, by: Sequence[str] = ("video", "point"), value: str = "value", band: str = "sd"
) -> DataFrame:
    """Mean over subjects per curve point with a band: one SD (ddof 0) or the 95 % interval of the mean."""
    y = finite(value)
    n, mean, sd = F.count(y), F.avg(y), F.stddev_pop(y)
    half = sd if band == "sd" else F.lit(1.96) * sd / F.sqrt(F.greatest(n, F.lit(1)))
    return curves.groupBy(*by).agg(
        n.alias("n"), mean.alias("mean"), (mean - half).alias("low"), (mean + half).alias("high")
    )


def channel_correlation(
    df: DataFrame, channels: Sequence[str], targets: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Pearson correlation of every channel with every target, in one pass."""
    by = list(by)
    pairs = [(c, g) for c in channels for g in targets]
    wide = df.groupBy(*by).agg(*[column_correlation(c, g).alias(f"{c}|{g}") for c, g in pairs])
    long = wide.unpivot(by, [f"`{c}|{g}`" for c, g in pairs], "_pair", "correlation")
    name = F.split("_pair", r"\|")
    return long.select(*by, name[0].alias("channel"), name[1].alias("target"), "correlation")


def column_correlation(a: str, b: str) -> Column:
    """Pearson correlation over the rows where both columns are finite."""
    x, y = finite(a), finite(b)
    both = x.isNotNull() & y.isNotNull()
    return F.corr(F.when(both, x), F.when(both, y))


def value_counts(df: DataFrame, cols: Sequence[str], k: int | None = None) -> DataFrame:
    """Row count per combination of values; the ``k`` most frequent on request."""
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), *cols).limit(k) if k else counted


def describe(df: DataFrame, cols: Sequence[str], max_rows: int | None = GATHER_ROWS) -> DataFrame:
    """Count, mean, std (ddof 1), minimum, exact quartiles and maximum, one row per column."""
    long = df.select(*cols).unpivot([], list(cols), "column", "value") if _same_type(df, cols) else (
        df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "column", "value")
    )
    y = finite("value")
    base = long.groupBy("column").agg(
        F.count(y).alias("count"),
        F.avg(y).alias("mean"),
        F.stddev_samp(y).alias("std"),
        F.min(y).alias("min"),
        F.max(y).alias("max"),
    )
    q = quantiles(long, ["column"], {"q25": ("value", 0.25), "q50": ("value", 0.5), "q75": ("value", 0.75)}, max_rows)
    return base.join(q, "column")


def _same_type(df: DataFrame, cols: Sequence[str]) -> bool:
    return {kind for name, kind in df.dtypes if name in cols} == {"double"}


def column_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: non-null count, minimum, maximum and number of rows, in a single pass."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in cols:
        y = finite(c)
        aggs.append(F.struct(F.count(y).alias("non_null"), F.min(y).alias("min"), F.max(y).alias("max")).alias(c))
    one = df.agg(*aggs)
    return one.unpivot(["rows"], list(cols), "column", "p").select("column", "rows", "p.non_null", "p.min", "p.max")


__all__ = [
    "BASE", "BASIC_BLOCK", "DIFFERENCES", "EXTENDED",
    "category_summary", "channel_correlation", "column_correlation", "column_profile", "describe",
    "excess_kurtosis", "least_squares_slope", "mean_curve", "minmax_profile", "skewness", "stats",
    "subject_video_features", "top_variance", "two_level_mean", "value_counts", "with_neighbours",
]

"""Sliding windows, macro windows, resampling and curve normalisation.

Windows are assigned by arithmetic on each row (an ``explode`` of the window numbers that cover it),
so a row is touched (length / step) times and no join is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from physio_spark.functions.columns import finite
from physio_spark.operators.ordered import attach, scan
from physio_spark.operators.quantiles import mode_of, quantiles


def _covering(offset: Column, length, step) -> Column:
    """Numbers of the windows [k*step, k*step + length) that contain ``offset`` (>= 0)."""
    length, step = F.lit(length), F.lit(step)
    first = F.greatest(F.lit(0), F.floor((offset - length) / step) + 1).cast("bigint")
    last = F.floor(offset / step).cast("bigint")
    return F.when(first <= last, F.sequence(first, last))  # null, so no row, between windows that do not touch


def time_windows(
    blocked: DataFrame,
    length: int,
    step: int,
    t: str = "t",
    anchor: str = "block_start",
    end: str = "block_end",
) -> DataFrame:
    """Windows inside blocks: start at the block's first sample, must end by its last sample.

    A row belongs to a window when ``win_start <= t < win_start + length``.  The trailing remainder of
    a block forms no window.  Drop windows of a single row with :func:`enough_rows` or in the
    aggregation (``n > 1``).
    """
    return (
        blocked.withColumn("win", F.explode(_covering(F.col(t) - F.col(anchor), length, step)))
        .withColumn("win_start", F.col(anchor) + F.col("win") * F.lit(step))
        .withColumn("win_end", F.col("win_start") + F.lit(length))
        .where(F.col("win_end") <= F.col(end))
    )


def video_windows(
    df: DataFrame,
    length: int,
    step: int,
    by: Sequence[str] = ("subject", "video"),
    t: str = "t",
    *,
    width: int,
    slack: int = 1000,
) -> DataFrame:
    """Windows per (subject, stimulus) rather than per run.

    Starts run from the first sample while ``start < last - length + slack`` (one millisecond in
    microseconds by default).  Combine with :func:`enough_rows` for the minimum-sample rule.
    """
    spans = scan(df, by, [t], width, whole={"_t0": ("min", F.col(t)), "_t1": ("max", F.col(t))})
    return (
        spans.withColumn("win", F.explode(_covering(F.col(t) - F.col("_t0"), length, step)))
        .withColumn("win_start", F.col("_t0") + F.col("win") * F.lit(step))
        .where(F.col("win_start") < F.col("_t1") - F.lit(length) + F.lit(slack))
        .withColumn("win_end", F.col("win_start") + F.lit(length))
        .drop("_t0", "_t1")
    )


def enough_rows(
    windowed: DataFrame, by: Sequence[str], min_rows: int = 2, t: str = "t", distinct_times: bool = False
) -> DataFrame:
    """Keep the rows of windows that hold at least ``min_rows`` rows (and two distinct times)."""
    by = list(by)
    sizes = windowed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    fit = F.col("_n") >= min_rows
    if distinct_times:
        fit = fit & (F.col("_lo") < F.col("_hi"))
    return windowed.join(sizes.where(fit).select(*by), by, "left_semi")


def count_windows(
    df: DataFrame,
    length_s: float,
    step_s: float,
    fs: float,
    by: Sequence[str] = ("subject",),
    t: str = "t",
    *,
    width: int,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Windows of a fixed number of samples over the whole recording; only full windows are kept.

    They may cross stimulus borders; label such a window with the mode of its stimulus ids.
    """
    size, hop = round(length_s * fs), round(step_s * fs)
    if size <= 1 or hop <= 0:
        raise ValueError("window must hold at least two samples and advance")
    rows = scan(df, by, [t, *tie], width, index="idx", whole={"_total": ("sum", F.lit(1))})
    return (
        rows.withColumn("win", F.explode(_covering(F.col("idx"), size, hop)))
        .where(F.col("win") * hop + size <= F.col("_total"))
        .drop("_total")
    )


def macro_windows(
    windows: DataFrame,
    seconds: int,
    hop: int,
    features: Sequence[str],
    by: Sequence[str] = ("subject", "video"),
    start: str | None = "window_start_ms",
    end: str | None = "window_end_ms",
    label: str | None = "label",
    order: Sequence[str] = (),
    default_label: str = "bored",
    width: int = 100_000,
    spacing_ms: int = 10_000,
) -> DataFrame:
    """Re-aggregate short windows into long chunks: feature means and the majority label.

    With a start time (milliseconds) chunks begin at the first window of the group and follow each
    other by ``hop`` while they begin no later than the last window; the tail may be partial.  A chunk
    needs ``max(3, length_ms // spacing_ms)`` windows.  Without a time column (``start=None``) chunks count
    rows in ``order`` (numeric column first, cut into chunks of ``width``).  If no chunk survives, the input comes back unchanged.
    """
    by = list(by)
    if start is not None:
        length_ms, hop_ms = int(seconds * 1000), int(hop * 1000)
        need = max(3, length_ms // spacing_ms)
        first = windows.groupBy(*by).agg(F.min(start).alias("_first"), F.max(start).alias("_last"))
        spans = attach(windows, first, by, salts=16)
        placed = (
            spans.withColumn("macro", F.explode(_covering(F.col(start) - F.col("_first"), length_ms, hop_ms)))
            .withColumn("macro_start_ms", F.col("_first") + F.col("macro") * hop_ms)
            .withColumn("macro_end_ms", F.col("macro_start_ms") + length_ms)
        )
        marks = [F.min("macro_start_ms").alias("macro_start_ms"), F.min("macro_end_ms").alias("macro_end_ms")]
    else:
        size = max(int(seconds), 60)
        step = max(max(int(hop), 30), size // 2)
        need = max(10, size // 5)
        placed = scan(windows, by, list(order), width, index="_i").withColumn(
            "macro", F.explode(_covering(F.col("_i"), size, step))
        )
        marks = [F.min("_i").alias("macro_first_row"), F.max("_i").alias("macro_last_row")]
    key = by + ["macro"]
    means = [F.avg(finite(c)).alias(c) for c in features]
    out = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n_windows"), *marks, *means)
    out = out.where(F.col("n_windows") >= need)
    if label:
        majority = mode_of(placed, key, label, label, default=default_label)
        out = out.join(majority, key)
    if out.isEmpty():
        return windows
    return out


def window_grid(
    windowed: DataFrame,
    by: Sequence[str],
    channels: Sequence[str],
    length: int,
    points: int,
    t: str = "t",
    start: str = "win_start",
    *,
    width: int,
) -> DataFrame:
    """Resample every window to ``points`` equidistant times, end excluded (long form).

    A window is left out when one of its channels has fewer than two finite values.
    """
    by = list(by)
    counts = windowed.groupBy(*by, start).agg(*[F.count(finite(c)).alias(f"_n_{c}") for c in channels])
    usable = F.lit(True)
    for c in channels:
        usable = usable & (F.col(f"_n_{c}") >= 2)
    kept = counts.where(usable).select(*by, start)
    # Grid times are integers in the unit of t when length / points is whole, doubles otherwise.
    step = length // points if length % points == 0 else length / points
    grid = kept.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        t, F.col(start) + F.col("point") * F.lit(step)
    )
    from physio_spark.operators.align import interp_join

    samples = windowed.select(*by, F.col(t).cast(grid.schema[t].dataType).alias(t), *channels)
    return interp_join(grid, samples, by, t, channels, width=width)


def window_tensor(grid: DataFrame, by: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Pack the long form of :func:`window_grid` into a channel-major ``ARRAY<ARRAY<FLOAT>>``."""
    ordered = F.array_sort(F.collect_list(F.struct("point", *[F.col(c).cast("float").alias(c) for c in channels])))
    packed = grid.groupBy(*by).agg(ordered.alias("_p"))
    pick = lambda c: F.transform("_p", lambda s: s[c])
    rows = [pick(c) for c in channels]
    complete = F.forall("_p", lambda s: _all_finite(s, channels))
    return packed.where(complete).select(*by, F.array(*rows).alias("x"))


def _all_finite(s: Column, channels: Sequence[str]) -> Column:
    ok = F.lit(True)
    for c in channels:
        ok = ok & s[c].isNotNull() & ~F.isnan(s[c])
    return ok


def normalize_curve(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    points: int = 600,
    t: str = "t",
    *,
    width: int,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Stretch or squeeze every series to ``points`` values, interpolating over the sample index."""
    by = list(by)
    rows = scan(
        df.where(F.col(value).isNotNull()),
        by,
        [t, *tie],
        width,
        index="idx",
        following={"_next": F.col(value)},
        whole={"_n": ("sum", F.lit(1))},
    )
    n, i = F.col("_n"), F.col("idx")
    last = F.lit(points - 1)
    # Grid point j sits at index j * (n - 1) / (points - 1); row i serves the points in [i, i + 1).
    low = F.ceil(i * last / (n - 1))
    high = F.when(i == n - 1, last).otherwise(F.ceil((i + 1) * last / (n - 1)) - 1)
    single = F.sequence(F.lit(0), last)
    served = F.when(n == 1, single).when(low <= high, F.sequence(low, high.cast("bigint")).cast("array<int>"))
    at = F.col("point") * (n - 1) / last
    share = at - i
    v = F.col(value)
    curve = F.when(F.col("_next").isNull() | (share <= 0), v).otherwise(v + share * (F.col("_next") - v))
    return (
        rows.withColumn("point", F.explode(served))
        .select(*by, "point", curve.alias("value"))
    )


def time_normalize(
    blocked: DataFrame,
    cols: Sequence[str],
    target: float | None = None,
    by: Sequence[str] = ("subject",),
    key: str = "video",
    t: str = "t",
    *,
    width: int,
    units_per_second: float = 1e6,
    fallback_fs: float = 20.0,
    skip: int = -1,
) -> DataFrame:
    """Warp every block of a recording to the same length and lay the blocks end to end.

    ``target`` is in seconds; by default the median block duration of the subject.  The number of
    points follows the block's own sampling rate; the next block starts one grid distance after the
    last point of the one before.
    """
    by = list(by)
    unit = F.lit(float(units_per_second))
    rows = blocked.where(F.col(key).isNotNull() & (F.col(key) != skip))
    gaps = scan(rows, by + ["block"], [t], width, prev={"_before": F.col(t)})
    typical = quantiles(
        gaps, by + ["block"], {"_dt": ((F.col(t) - F.col("_before")).cast("double"), 0.5)}
    )
    table = rows.groupBy(*by, "block", key).agg(F.min(t).alias("_s"), F.max(t).alias("_e"))
    table = table.join(typical, by + ["block"]).withColumn("_dur", (F.col("_e") - F.col("_s")) / unit)
    if target is None:
        common = quantiles(table, by, {"_len": ("_dur", 0.5)})
        table = table.join(common, by)
    else:
        table = table.withColumn("_len", F.lit(float(target)))
    fs = F.when(F.col("_dt") > 0, unit / F.col("_dt")).otherwise(F.lit(fallback_fs))
    table = table.withColumn("_n", F.greatest(F.rint(F.col("_len") * fs).cast("bigint"), F.lit(2)))
    table = table.withColumn("_hop", F.col("_len") / (F.col("_n") - 1))
    w = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    origin = F.min("_s").over(Window.partitionBy(*by)) / unit
    table = table.withColumn("_cursor", origin + F.coalesce(F.sum(F.col("_len") + F.col("_hop")).over(w), F.lit(0.0)))
    grid = (
        table.withColumn("point", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumn("_rel", F.col("point") * F.col("_hop"))
        .select(*by, "block", key, "point", "_rel", (F.col("_cursor") + F.col("_rel")).alias("time_s"))
    )
    starts = table.select(*by, "block", "_s")
    samples = attach(rows, starts, by + ["block"], salts=16).select(
        *by, "block", ((F.col(t) - F.col("_s")) / unit).alias("_rel"), *cols
    )
    from physio_spark.operators.align import interp_join

    # The relative axis is in seconds here, so the chunk width is scaled to it.
    return interp_join(grid, samples, by + ["block"], "_rel", cols, width=max(1, int(width / units_per_second))).drop(
        "_rel"
    )


__all__ = [
    "count_windows",
    "enough_rows",
    "macro_windows",
    "normalize_curve",
    "time_normalize",
    "time_windows",
    "video_windows",
    "window_grid",
    "window_tensor",
]

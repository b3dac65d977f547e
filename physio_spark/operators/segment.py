"""Splitting a recording into contiguous segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from physio_spark.operators.ordered import CHUNK, attach, chunk_of, scan
from physio_spark.operators.quantiles import quantiles


def blocks(
    df: DataFrame,
    by: Sequence[str] = ("subject",),
    t: str = "t",
    key: str = "video",
    *,
    width: int,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Number the runs of equal ``key`` in time order.

    Adds ``block`` (1, 2, ...), ``block_start`` and ``block_end`` (first and last time of the run).
    A value that returns later opens a new block.
    """
    by = list(by)
    keys = [*by, CHUNK]
    columns = df.columns
    order = [t, *tie]
    k = F.struct(F.col(key).alias("k"))
    up = Window.partitionBy(*keys).orderBy(*order)
    down = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    to_here = (Window.unboundedPreceding, Window.currentRow)

    # Inside a chunk: runs are counted from 0, and the first and last run stay open at the border.
    local = df.withColumn(CHUNK, chunk_of(t, width)).withColumns(
        {
            "_opens": F.lag(k).over(up).isNotNull() & ~F.lag(k).over(up)["k"].eqNullSafe(F.col(key)),
            "_closes": F.lead(k).over(up).isNotNull() & ~F.lead(k).over(up)["k"].eqNullSafe(F.col(key)),
        }
    )
    local = local.withColumns(
        {
            "_run": F.sum(F.col("_opens").cast("bigint")).over(up.rowsBetween(*to_here)),
            "_from": F.last(F.when(F.col("_opens"), F.col(t)), ignorenulls=True).over(up.rowsBetween(*to_here)),
            "_to": F.last(F.when(F.col("_closes"), F.col(t)), ignorenulls=True).over(down.rowsBetween(*to_here)),
        }
    )

    # One row per chunk decides whether its first run continues the chunk before.
    rank = F.struct(*order)
    table = local.groupBy(*keys).agg(
        F.min_by(k, rank).alias("_k0"),
        F.max_by(k, rank).alias("_k1"),
        F.min(t).alias("_t0"),
        F.max(t).alias("_t1"),
        F.sum(F.col("_opens").cast("bigint")).alias("_n"),
        F.max(F.when(F.col("_opens"), F.col(t))).alias("_last_from"),
        F.min(F.when(F.col("_closes"), F.col(t))).alias("_first_to"),
    )
    chunks_up = Window.partitionBy(*by).orderBy(CHUNK)
    chunks_down = Window.partitionBy(*by).orderBy(F.desc(CHUNK))
    before = (Window.unboundedPreceding, -1)
    table = table.withColumns(
        {
            "_new": ~F.coalesce(F.lag("_k1").over(chunks_up)["k"].eqNullSafe(F.col("_k0")["k"]), F.lit(False))
            | F.lag("_k1").over(chunks_up).isNull(),
            "_ends": ~F.coalesce(F.lead("_k0").over(chunks_up)["k"].eqNullSafe(F.col("_k1")["k"]), F.lit(False))
            | F.lead("_k0").over(chunks_up).isNull(),
        }
    )
    begun = F.coalesce("_last_from", F.when(F.col("_new"), F.col("_t0")))
    ended = F.coalesce("_first_to", F.when(F.col("_ends"), F.col("_t1")))
    offset = F.coalesce(F.sum("_n").over(chunks_up.rowsBetween(*before)), F.lit(0))
    state = table.select(
        *keys,
        (offset + F.sum(F.col("_new").cast("bigint")).over(chunks_up.rowsBetween(*to_here))).alias("_offset"),
        F.when(F.col("_new"), F.col("_t0"))
        .otherwise(F.last(begun, ignorenulls=True).over(chunks_up.rowsBetween(*before)))
        .alias("_carry_from"),
        F.when(F.col("_ends"), F.col("_t1"))
        .otherwise(F.last(ended, ignorenulls=True).over(chunks_down.rowsBetween(*before)))
        .alias("_carry_to"),
    )
    return local.join(state, keys, "left").select(
        *columns,
        (F.col("_run") + F.col("_offset")).alias("block"),
        F.coalesce("_from", "_carry_from").alias("block_start"),
        F.coalesce("_to", "_carry_to").alias("block_end"),
    )


def segments(blocked: DataFrame, by: Sequence[str] = ("subject",), t: str = "t", key: str = "video") -> DataFrame:
    """One row per block: start, end, duration (unit of ``t``) and number of samples."""
    return (
        blocked.groupBy(*by, "block", key)
        .agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count(F.lit(1)).alias("n"))
        .withColumn("duration", F.col("end") - F.col("start"))
    )


def sampling_rate(
    df: DataFrame,
    by: Sequence[str],
    t: str = "t",
    *,
    width: int,
    units_per_second: float = 1e6,
    variant: str = "window",
    fallback: float = 1000.0,
) -> DataFrame:
    """Sampling rate per group, from the median distance of neighbouring samples.

    ``window``   float rate; 0 when the median distance is not positive
    ``integer``  rounded, at least 1; ``fallback`` when there is no distance at all
    ``positive`` only positive distances count; ``fallback`` for fewer than 3 rows
    """
    gaps = scan(df, by, [t], width, prev={"_before": F.col(t)}).withColumn("_gap", F.col(t) - F.col("_before"))
    gap = F.col("_gap").cast("double")
    if variant == "positive":
        gap = F.when(gap > 0, gap)
    sizes = gaps.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    typical = quantiles(gaps, by, {"_dt": (gap, 0.5)})
    rate = F.lit(units_per_second) / F.col("_dt")
    if variant == "window":
        fs = F.when(F.col("_dt") > 0, rate).otherwise(F.lit(0.0))
    elif variant == "integer":
        fs = F.when(F.col("_dt") > 0, F.greatest(F.rint(rate), F.lit(1.0))).otherwise(F.lit(float(fallback)))
    else:
        fs = F.when((F.col("_rows") >= 3) & F.col("_dt").isNotNull(), rate).otherwise(F.lit(float(fallback)))
    return typical.join(sizes, list(by)).select(*by, fs.alias("fs"))


def serial_timeline(
    segment_table: DataFrame,
    order: Sequence,
    by: Sequence[str] = ("subject",),
    key: str = "video",
) -> DataFrame:
    """Lay segments end to end in a fixed order of ids; ``offset`` is where each one begins.

    Ids missing for a subject are skipped; ids outside ``order`` are left out.
    """
    position = F.array_position(F.array(*[F.lit(k) for k in order]), F.col(key))
    chosen = segment_table.where(F.col(key).isin(list(order))).withColumn("position", position)
    w = Window.partitionBy(*by).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return chosen.withColumn("offset", F.coalesce(F.sum("duration").over(w), F.lit(0)))


def cumulative_axis(
    windows: DataFrame,
    by: Sequence[str] = ("subject",),
    key: str = "video",
    start: str = "start_s",
    end: str = "end_s",
    floor: float = 1e-6,
) -> DataFrame:
    """Position of every window on the joined time axis of its subject.

    Stimuli follow each other by their first window; each one takes the span of its own windows.
    """
    by = list(by)
    spans = windows.groupBy(*by, key).agg(F.min(start).alias("_s"), F.max(end).alias("_e"))
    spans = spans.withColumn("_d", F.greatest(F.col("_e") - F.col("_s"), F.lit(floor)))
    w = Window.partitionBy(*by).orderBy("_s", key).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("offset_s", F.coalesce(F.sum("_d").over(w), F.lit(0.0)))
    return (
        attach(windows, spans, by + [key], salts=8)
        .withColumn("axis_s", F.col("offset_s") + F.col(end) - F.col("_s"))
        .drop("_s", "_e", "_d")
    )


def relative_axis(
    windows: DataFrame,
    segment_table: DataFrame,
    by: Sequence[str] = ("subject",),
    key: str = "video",
    end: str = "end_s",
    share: float = 0.8,
    slack: float = 1.1,
) -> DataFrame:
    """Cumulative axis when window times may be relative to the stimulus or to the recording.

    ``segment_table`` holds ``start`` and ``duration`` (seconds) of each stimulus.  A stimulus counts
    as relative when at least ``share`` of its windows end within ``slack`` times its duration;
    positions are clamped to the stimulus.
    """
    by = list(by)
    w = Window.partitionBy(*by).orderBy("start", key).rowsBetween(Window.unboundedPreceding, -1)
    spans = segment_table.select(*by, key, "start", "duration").withColumn(
        "offset_s", F.coalesce(F.sum("duration").over(w), F.lit(0.0))
    )
    within = (F.col(end) <= F.lit(slack) * F.col("duration")).cast("int")
    modes = (
        attach(windows, spans, by + [key], salts=8)
        .groupBy(*by, key)
        .agg((F.avg(F.coalesce(within, F.lit(0))) >= share).alias("relative"))
    )
    local = F.when(F.col("relative"), F.col(end)).otherwise(F.col(end) - F.col("start"))
    clamped = F.greatest(F.lit(0.0), F.least(local, F.col("duration")))
    return (
        attach(windows, spans.join(modes, by + [key]), by + [key], salts=8)
        .withColumn("axis_s", F.col("offset_s") + clamped)
        .drop("start", "duration")
    )

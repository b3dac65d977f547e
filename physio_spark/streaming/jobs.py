"""Structured Streaming forms of the window statistics, the segment table and the running vote."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from physio_spark.functions.columns import finite


def window_stats_stream(
    samples: DataFrame,
    length: str,
    step: str,
    by: Sequence[str] = ("subject",),
    value: str = "value",
    ts: str = "ts",
    late: str = "10 minutes",
) -> DataFrame:
    """Sliding-window statistics of a live sample stream; rows behind the watermark are dropped.

    Windows are aligned to the epoch, not to the start of a block.  Also runs on a batch frame.
    """
    y = finite(value)
    return (
        samples.withWatermark(ts, late)
        .groupBy(*by, F.window(ts, length, step).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(y).alias("mean"),
            F.stddev_pop(y).alias("std"),
            F.min(y).alias("min"),
            F.max(y).alias("max"),
        )
        .select(*by, F.col("w.start").alias("win_start"), F.col("w.end").alias("win_end"), "n", "mean", "std", "min", "max")
    )


def session_stream(
    samples: DataFrame, gap: str, by: Sequence[str] = ("subject", "video"), ts: str = "ts", late: str = "10 minutes"
) -> DataFrame:
    """Live block table: a block closes once no sample arrived for ``gap``."""
    return (
        samples.withWatermark(ts, late)
        .groupBy(*by, F.session_window(ts, gap).alias("s"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end"))
        .select(*by, "start", "end", "n")
    )


def running_vote_stream(
    predictions: DataFrame,
    by: Sequence[str] = ("subject", "video"),
    ts: str | None = None,
    ttl_s: float = 86_400.0,
    late: str = "10 minutes",
    closing: bool = False,
) -> DataFrame:
    """Running share of correct windows per stimulus; one updated row per stimulus and micro-batch.

    ``predictions`` holds the keys, ``true_label`` and ``pred_label``.  The state is two counters.  With the event
    time ``ts`` it lives for ``ttl_s`` seconds after a stimulus' last window, by the watermark; a stimulus that comes
    back later begins anew, and rows without a key only move the watermark.  ``closing`` gives one row for
    each stimulus, when its time is over, for append-mode sinks: its counters are the state of a session whose gap
    is the time to live, so no stimulus is a call of its own.
    """
    by = list(by)
    if closing and ts is None:
        raise ValueError("a vote closes by event time: name its column")
    hit = (F.col("pred_label") == F.col("true_label")).cast("bigint").alias("hit")
    if closing:
        alive = F.session_window(ts, f"{round(ttl_s * 1e6)} microseconds")
        named = F.max(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by]))  # a filter on keys would be pushed below the watermark
        counted = predictions.withWatermark(ts, late).select(*by, hit, ts).groupBy(*by, alive).agg(
            F.sum(F.coalesce("hit", F.lit(0))).alias("votes"), F.count(F.lit(1)).alias("n_seen"), named.alias("_named")
        )
        return counted.where("_named").select(*by, "votes", "n_seen", (F.col("votes") / F.col("n_seen")).alias("share"))
    seconds = (F.col(ts).cast("timestamp").cast("double") if ts else F.lit(0.0)).alias("seconds")
    if ts:
        keyed = predictions.withWatermark(ts, late).select(*by, hit, seconds, ts)
    else:
        keyed = predictions.select(*by, hit, seconds)
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.select(*by).schema)

    def row(key: tuple, votes: int, seen: int) -> pd.DataFrame:
        return pd.DataFrame({**{c: [k] for c, k in zip(by, key, strict=True)}, "votes": votes, "n_seen": seen, "share": votes / seen})

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if ts and any(pd.isna(k) for k in key):  # not a filter: it would be pushed below the watermark
            return
        if state.hasTimedOut:
            state.remove()
            return
        votes, seen, last = state.get if state.exists else (0, 0, 0.0)
        for pdf in batches:
            votes += int(pdf["hit"].fillna(0).sum())
            seen += len(pdf)
            last = max(last, float(pdf["seconds"].max()))
        state.update((votes, seen, last))
        if ts:
            state.setTimeoutTimestamp(max(int((last + ttl_s) * 1000), state.getCurrentWatermarkMs() + 1))
        yield row(key, votes, seen)

    return keyed.groupBy(*by).applyInPandasWithState(
        update,
        outputStructType=f"{keys}, votes bigint, n_seen bigint, share double",
        stateStructType="votes bigint, seen bigint, last double",
        outputMode="update",
        timeoutConf=GroupStateTimeout.EventTimeTimeout if ts else GroupStateTimeout.NoTimeout,
    )


def final_vote(predictions: DataFrame, by: Sequence[str] = ("subject", "video")) -> DataFrame:
    """Vote share after the last window: plain counters, in batch or as an update-mode stream."""
    hit = (F.col("pred_label") == F.col("true_label")).cast("bigint")
    counted = predictions.groupBy(*by).agg(F.sum(F.coalesce(hit, F.lit(0))).alias("votes"), F.count(F.lit(1)).alias("n_seen"))
    return counted.withColumn("share", F.col("votes") / F.col("n_seen"))

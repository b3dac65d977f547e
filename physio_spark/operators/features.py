"""Complete feature rows: everything known about one window, one output row per window."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from physio_spark.functions.columns import first_valid
from physio_spark.operators.align import interp_join, interval_agg, shift_labels
from physio_spark.operators.ordered import scan
from physio_spark.operators.panes import window_band_peaks, window_stats, windows_per_stretch
from physio_spark.operators.quantiles import mode_of
from physio_spark.operators.segment import blocks
from physio_spark.operators.signal import derive_tracks, hrv_time, ibi, peaks
from physio_spark.operators.stats import BASE, DIFFERENCES, with_neighbours
from physio_spark.operators.windows import time_windows
from physio_spark.runtime import materialize


@dataclass(frozen=True)
class FeatureConfig:
    """Window geometry (unit of ``t``), sampling rate and the channel that carries the pulse."""

    length: int
    step: int
    fs: float
    beat_channel: str
    channels: Sequence[str]
    spec: Sequence[str] = (*BASE, *DIFFERENCES)
    label_shift: int = 0
    units_per_second: float = 1e6
    beat_threshold: float = 1.0
    beat_distance_s: float = 0.3
    baseline_s: float = 10.0
    smooth_s: float = 0.5
    chunk: int = 100_000


def window_features(
    samples: DataFrame,
    annotations: DataFrame | None,
    config: FeatureConfig,
    *,
    width: int,
    subject: str = "subject",
    t: str = "t",
    key: str = "video",
) -> DataFrame:
    """Align, split into blocks, derive tracks once per block, cut windows and summarise them.

    Output per window: keys, ``n_rows``, stimulus id, mean labels, statistics of every channel and
    track, and the beat features of the intervals that end inside the window.
    """
    labels: list[str] = []
    if annotations is not None:
        labels = ["valence", "arousal"]
        samples = interp_join(samples, annotations, [subject], t, labels, width=width)
        samples = shift_labels(samples, config.label_shift, [subject], t, labels, width=width)
    block_by = [subject, "block"]
    blocked = materialize(blocks(samples, [subject], t, key, width=width))
    tracked = derive_tracks(
        blocked, config.beat_channel, config.fs, block_by, t, config.beat_threshold, config.beat_distance_s,
        width=width, chunk=config.chunk, baseline_s=config.baseline_s, smooth_s=config.smooth_s,
    ).drop("idx")
    tracks = ["tonic", "phasic", "rate", "envelope"]
    channels = list(config.channels)
    rows = with_neighbours(tracked, block_by, channels, t, width=width)
    win_by = [subject, "block", key, "win", "win_start", "win_end"]
    extra = {f"label_{c}": ("mean", c) for c in labels} | {f"{c}_mean": ("mean", c) for c in tracks}
    base = window_stats(
        rows, [subject, "block", key], channels, config.spec, config.length, config.step, t,
        fs=config.fs, unit=config.units_per_second, extra=extra,
    ).where("n_rows > 1")
    beats = peaks(
        blocked, config.beat_channel, block_by, t, config.beat_threshold,
        max(int(config.beat_distance_s * config.fs), 1), width=width, chunk=config.chunk,
    )
    intervals = ibi(beats, block_by, "idx", config.fs, 1000.0, width=config.chunk)
    in_windows = time_windows(intervals, config.length, config.step, t)
    variability = hrv_time(in_windows, win_by).withColumn("bpm", F.lit(60_000.0) / F.col("ibi_mean"))
    return base.join(variability, win_by, "left")


@dataclass(frozen=True)
class PulseConfig:
    """Windows of samples over a whole recording, and how beats and rates are found in them."""

    fs: float
    length_s: float = 10.0
    step_s: float = 1.0
    pulse: str = "bvp"
    conductance: str = "gsr"
    temperature: str = "skt"
    beat_threshold: float = 1.0
    beat_distance_s: float = 0.3
    rate_band: tuple[float, float, float] = (0.7, 3.5, 0.05)
    breath_band: tuple[float, float, float] = (0.1, 0.6, 0.02)
    interval_unit_ms: float = 1.0
    chunk: int = 100_000


PULSE_FEATURES = (
    "bvp_bpm", "bvp_ibi", "bvp_sdnn", "bvp_sdsd", "bvp_rmssd", "bvp_pnn20", "bvp_pnn50", "bvp_mad", "bvp_sd1", "bvp_sd2",
    "bvp_s", "bvp_sd1sd2", "bvp_breathingrate", "gsr_mean", "gsr_slope", "skt_mean", "skt_slope",
)


def pulse_window_features(
    samples: DataFrame,
    annotations: DataFrame | None,
    config: PulseConfig,
    *,
    width: int,
    subject: str = "subject",
    t: str = "t",
    key: str = "video",
) -> DataFrame:
    """The seventeen :data:`PULSE_FEATURES` of every full window of samples, with its stimulus and mean ratings.

    Beats are found once per recording; an interval belongs to the windows that hold both its beats, which is
    arithmetic on their indices, and a change of intervals to those that hold all three.  A window needs two
    intervals.  The rate is the first valid one of: from the mean interval, the mean of the rates, the strongest
    frequency of the rate band.  Means, slopes and the votes for the stimulus come from panes, spectra
    from the samples of a stretch of windows.
    Output: ``subject, win, window_start, window_end`` (times of the first and last sample), ``video_id`` (most
    frequent, smallest on a tie), ``arousal, valence`` (mean of the annotations inside) and the features.
    """
    size, hop = round(config.length_s * config.fs), round(config.step_s * config.fs)
    if size <= 1 or hop <= 0:
        raise ValueError("window must hold at least two samples and advance")
    columns = [config.pulse, config.conductance, config.temperature]
    rows = scan(samples.select(subject, t, key, *columns), [subject], [t], width, index="idx", whole={"_total": ("sum", F.lit(1))})
    rows = materialize(rows.withColumn("_zero", F.lit(0).cast("long")))
    place = {"t": "idx", "anchor": "_zero", "end": "_total"}
    slow = window_stats(
        rows, [subject], columns[1:], ["mean", "slope_fit"], size, hop, **place, empty=None,
        extra={"window_start": ("min", t), "window_end": ("max", t)},
    ).drop("win_start", "win_end", "n_rows")
    votes = window_stats(rows.where(F.col(key).isNotNull()), [subject, key], [], [], size, hop, **place)
    shown = votes.groupBy(subject, "win").agg(F.min_by(key, F.struct(-F.col("n_rows"), F.col(key))).alias("video_id"))

    beats = peaks(
        rows.select(subject, t, config.pulse), config.pulse, [subject], t, config.beat_threshold,
        max(int(config.beat_distance_s * config.fs), 1), width=width, chunk=config.chunk,
    )
    between = ibi(beats, [subject], "idx", config.fs, 1000.0, width=config.chunk)
    beats_before = lambda ms: F.round(ms * F.lit(config.fs / 1000.0)).cast("long")
    opened = F.col("idx") - beats_before(F.col("ibi"))
    between = between.select(subject, "idx", "ibi", "ibi_diff", "rate", opened.alias("_p0"))
    between = between.withColumn("_p1", F.col("_p0") - beats_before(F.col("ibi") - F.col("ibi_diff")))
    first = F.greatest(F.lit(0), F.floor((F.col("idx") - F.lit(size)) / F.lit(hop)) + 1).cast("bigint")
    last = F.floor(F.col("_p0") / F.lit(hop)).cast("bigint")
    # the intervals travel to the stretch of their windows and are copied to each window only there
    stretch = windows_per_stretch(size, hop)
    reach = F.sequence(F.floor(first / stretch), F.floor(last / stretch))
    dealt = between.where(first <= last).withColumn("_stretch", F.explode(reach)).repartition(subject, "_stretch")
    own = F.sequence(F.greatest(first, F.col("_stretch") * stretch), F.least(last, F.col("_stretch") * stretch + stretch - 1))
    held = dealt.withColumn("win", F.explode(own))
    held = held.withColumn("ibi_diff", F.when(F.col("_p1") >= F.col("win") * F.lit(hop), F.col("ibi_diff")))
    spread = hrv_time(
        held, [subject, "_stretch", "win"], ddof=1, as_percent=False, unit_ms=config.interval_unit_ms, max_rows=None, also=[F.avg("rate").alias("_rate")]
    ).where("n_ibi >= 2").drop("_stretch")

    bands = {"_fft": config.rate_band, "bvp_breathingrate": config.breath_band}
    spectra = window_band_peaks(rows, config.pulse, [subject], size, hop, config.fs, bands)
    out = slow.join(shown, [subject, "win"], "left").join(spread, [subject, "win"], "left").join(spectra, [subject, "win"], "left")
    if annotations is not None:
        out = interval_agg(out, annotations, [subject], "window_start", "window_end", t, ["valence", "arousal"], width=width, salts=None)
    else:
        out = out.withColumns({c: F.lit(None).cast("double") for c in ("valence", "arousal")})
    named = {
        "bvp_bpm": first_valid(F.lit(60_000.0) / F.col("ibi_mean"), F.col("_rate"), F.col("_fft")),
        "bvp_ibi": F.col("ibi_mean"), "bvp_s": F.col("ellipse"), "bvp_sd1sd2": F.col("sd1_sd2"), "bvp_breathingrate": F.col("bvp_breathingrate"),
        **{f"bvp_{c}": F.col(c) for c in ("sdnn", "sdsd", "rmssd", "pnn20", "pnn50", "mad", "sd1", "sd2")},
        "gsr_mean": F.col(f"{config.conductance}_mean"), "gsr_slope": F.col(f"{config.conductance}_slope_fit"),
        "skt_mean": F.col(f"{config.temperature}_mean"), "skt_slope": F.col(f"{config.temperature}_slope_fit"),
    }
    return out.select(subject, "win", "window_start", "window_end", "video_id", "arousal", "valence", *[named[c].alias(c) for c in PULSE_FEATURES])


def count_window_features(
    windowed: DataFrame, channel_means: Sequence[str], by: Sequence[str] = ("subject", "win"), key: str = "video"
) -> DataFrame:
    """Mean and fitted slope of slow channels over sample-count windows, labelled by the mode stimulus."""
    by = list(by)
    slope = lambda c: F.when(F.count(c) >= 3, F.coalesce(F.regr_slope(F.col(c), F.col("idx")), F.lit(0.0)))
    aggs = [a for c in channel_means for a in (F.avg(c).alias(f"{c}_mean"), slope(c).alias(f"{c}_slope"))]
    return windowed.groupBy(*by).agg(*aggs).join(mode_of(windowed, by, key, f"{key}_id"), by)

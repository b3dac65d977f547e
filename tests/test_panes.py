"""Windows put together from panes against windows of copied rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from physio_spark.operators import panes, windows
from physio_spark.operators import stats as S
from physio_spark.operators.segment import blocks
from physio_spark.operators.windows import time_windows

SPEC = sorted(panes.KNOWN)
BY = ["subject", "block"]
WIN = [*BY, "win", "win_start", "win_end"]


@pytest.fixture(scope="module")
def recordings(spark):
    """Two recordings far from zero with gaps, ties, missing values, a flat stretch and a returning stimulus."""
    rng = random.Random(1)
    rows = []
    for subject in range(2):
        t = 1000
        for i in range(300):
            t += 200 if i % 50 == 0 else rng.choice([0, 1, 1, 2, 3, 17])
            x = rng.choice([None, math.nan, math.inf, 1e4]) if rng.random() < 0.2 else rng.gauss(1e4, 1)
            rows.append((subject, t, i, 1 + (i // 100) % 2, x, 5.0 if i % 100 < 60 else rng.random()))
    df = spark.createDataFrame(rows, "subject int, t long, i int, video int, x double, y double")
    return S.with_neighbours(blocks(df, width=500, tie=["i"]), BY, ["x", "y"], width=500, tie=["i"]).cache()


def rows_of(frame):
    return {tuple(r[c] for c in WIN): r.asDict() for r in frame.collect()}


def same(a, b):
    return (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6))


@pytest.mark.parametrize(("length", "step"), [(20, 10), (30, 7), (10, 25), (64, 64)])
def test_panes_give_the_statistics_of_copied_rows(recordings, length, step):
    copied = S.stats(time_windows(recordings, length, step), WIN, ["x", "y"], SPEC, fs=2.0, window=("win_start", "win_end"), unit=10.0)
    want = rows_of(copied)
    got = rows_of(panes.window_stats(recordings, BY, ["x", "y"], SPEC, length, step, fs=2.0, unit=10.0, extra={"mean_i": ("mean", "i")}))
    assert got.keys() == want.keys()
    assert want
    for key, row in want.items():
        assert not [c for c in row if not same(row[c], got[key][c])], key
    means = rows_of(time_windows(recordings, length, step).groupBy(*WIN).agg(F.avg("i").alias("m")))
    assert all(same(got[k]["mean_i"], means[k]["m"]) for k in want)


def test_windows_too_full_to_gather_are_bracketed(recordings):
    args = (recordings, BY, ["x"], ["median", "iqr", "mad", "mean", "zero_crossings"], 30, 10)
    whole, bracketed = (rows_of(panes.window_stats(*args, max_rows=n, extra={"m": ("mean", "i"), "top": ("max", "i")})) for n in (10_000, 3))
    assert whole.keys() == bracketed.keys()
    assert all(same(whole[k][c], bracketed[k][c]) for k in whole for c in whole[k])


def test_rows_are_summarised_before_they_are_copied(recordings):
    plan = panes.window_stats(recordings, BY, ["x"], ["mean", "std0", "slope"], 60, 2)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    first_copy = max(i for i, line in enumerate(lines) if "Generate explode" in line)  # the lowest in the tree
    assert any("partial_" in line and "_pane" in line for line in lines[first_copy:])


def test_nothing_and_unknown_names(recordings):
    assert panes.window_stats(recordings.where("subject > 5"), BY, ["x"], ["mean", "median"], 20, 10).count() == 0
    assert panes.window_stats(recordings, BY, ["x"], ["mean"], 10**9, 10).count() == 0
    with pytest.raises(ValueError, match="unknown"):
        panes.window_stats(recordings, BY, ["x"], ["average"], 20, 10)


def test_windows_that_do_not_touch_leave_rows_out(spark):
    df = spark.createDataFrame([(0, t, 0, 99) for t in range(100)], "subject int, t long, block_start long, block_end long")
    got = sorted((r["win"], r["t"]) for r in windows.time_windows(df, 10, 25).collect())
    assert got == [(k, t) for k in range(4) for t in range(25 * k, 25 * k + 10)]


def test_spectra_from_panes_are_those_of_whole_windows(spark):
    from physio_spark.operators import signal as G

    rng = random.Random(3)
    rows = [(s, i, 50 + 5 * math.sin(2 * math.pi * (0.3 + 0.1 * s) * i / 4) + rng.gauss(0, 1)) for s in range(3) for i in range(200)]
    rows = [(s, i, None if rng.random() < 0.1 else v, 0, 200) for s, i, v in rows]
    df = spark.createDataFrame(rows, "subject int, idx long, x double, _zero long, _total long")
    size, hop = 48, 20
    copied = df.withColumnRenamed("_total", "_end").withColumn("_zero", F.lit(0))
    copied = time_windows(copied, size, hop, "idx", "_zero", "_end")
    at = F.col("idx") - F.col("win_start")
    want = G.band_peak(copied, "x", ["subject", "win"], at / 4.0, 0.1, 0.6, 0.05, taper=G.hann(at / float(size)))
    want = {(r["subject"], r["win"]): r["per_min"] for r in want.collect()}
    got = panes.window_band_peaks(df, "x", ["subject"], size, hop, 4.0, {"rate": (0.1, 0.6, 0.05), "low": (0.1, 0.1, 0.05)}).collect()
    assert {(r["subject"], r["win"]): r["rate"] for r in got} == want
    assert {r["low"] for r in got} == {6.0}
    assert len(want) == 3 * 8


def test_seventeen_features_of_a_steady_pulse(spark):
    from physio_spark.operators.features import PULSE_FEATURES, PulseConfig, pulse_window_features

    fs, beat = 10.0, 1.25
    rows = [(1, i * 100, 1 + i // 300, math.sin(2 * math.pi * beat * i / fs + 0.1) + 0.2 * math.sin(2 * math.pi * 0.25 * i / fs), 2.0 * i, 30.0) for i in range(600)]
    df = spark.createDataFrame(rows, "subject int, t long, video int, bvp double, gsr double, skt double")
    ratings = spark.createDataFrame([(1, i * 1000, 5.0, float(i)) for i in range(60)], "subject int, t long, valence double, arousal double")
    out = pulse_window_features(df, ratings, PulseConfig(fs, beat_threshold=0.5), width=10_000).orderBy("win").collect()
    assert len(out) == 51
    assert out[0].asDict().keys() == {"subject", "win", "window_start", "window_end", "video_id", "arousal", "valence", *PULSE_FEATURES}
    for r in out:
        assert r["window_end"] - r["window_start"] == 9900
        assert r["bvp_bpm"] == pytest.approx(75, abs=1.5)
        assert r["bvp_breathingrate"] == pytest.approx(15, abs=1.5)
        assert (r["gsr_slope"], r["skt_slope"], r["skt_mean"], r["valence"]) == (pytest.approx(2), pytest.approx(0), 30, 5)
        assert r["arousal"] == pytest.approx(r["win"] + 4.5)
    assert [out[0]["video_id"], out[-1]["video_id"]] == [1, 2]
    flat = df.withColumn("bvp", F.lit(1.0))
    for r in pulse_window_features(flat, None, PulseConfig(fs), width=10_000).collect():
        assert (r["bvp_bpm"], r["bvp_ibi"], r["bvp_sd2"], r["valence"]) == (None, None, None, None)
        assert r["gsr_mean"] is not None

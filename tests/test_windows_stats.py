"""Window, statistic, label and table rules on hand-made frames."""

import math
import statistics as st

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from physio_spark.functions import labels as L
from physio_spark.functions.columns import clip, finite, first_valid, to_numeric
from physio_spark.operators import clean, project, segment, signal, windows
from physio_spark.operators import stats as S

NAN, INF = float("nan"), float("inf")


def one(df):
    return df.collect()[0].asDict()


def test_returning_value_opens_a_new_block(spark):
    df = spark.createDataFrame([(1, t, v) for t, v in enumerate([1, 1, 2, 2, 1])], "subject int, t long, video int")
    got = segment.segments(segment.blocks(df, width=2)).orderBy("block").collect()
    assert [(r["video"], r["start"], r["end"], r["n"]) for r in got] == [(1, 0, 1, 2), (2, 2, 3, 2), (1, 4, 4, 1)]


def test_time_windows_anchor_edge_and_tail(spark):
    def starts(times, length, step):
        df = spark.createDataFrame([(1, t, 1, 1.0) for t in times], "subject int, t long, video int, x double")
        w = windows.time_windows(segment.blocks(df, width=3), length, step)
        return {r["win_start"]: r["count"] for r in w.groupBy("win_start").count().collect()}

    assert starts(range(11), 4, 2) == {0: 4, 2: 4, 4: 4, 6: 4}
    assert starts(range(10), 4, 2) == {0: 4, 2: 4, 4: 4}  # the last window would end one unit too late
    assert starts(range(3), 4, 2) == {}
    assert starts([5, 6, 9, 13], 4, 2) == {5: 2, 7: 1, 9: 1}


@pytest.mark.parametrize(("duration", "length", "step"), [(97, 10, 3), (50, 50, 7), (60, 20, 20)])
def test_window_count_formula(spark, duration, length, step):
    df = spark.createDataFrame([(1, t, 1) for t in range(duration + 1)], "subject int, t long, video int")
    w = windows.time_windows(segment.blocks(df, width=13), length, step)
    assert w.select("win").distinct().count() == (duration - length) // step + 1


def test_video_windows_need_rows_and_distinct_times(spark):
    df = spark.createDataFrame([(1, 1, t) for t in (0, 0, 0, 1000, 6000)], "subject int, video int, t long")
    w = windows.video_windows(df, 3000, 1000, width=1000, slack=1)
    kept = windows.enough_rows(w, ["subject", "video", "win"], 3, distinct_times=True)
    assert {r["win"] for r in kept.select("win").collect()} == {0}


def test_macro_windows_return_input_when_nothing_survives(spark):
    df = spark.createDataFrame([(1, 1, 0, 1.0, "a")], "subject int, video int, window_start_ms long, x double, label string")
    assert windows.macro_windows(df, 120, 60, ["x"]) is df


def test_macro_windows_partial_tail(spark):
    rows = [(1, 1, 1000 * s, float(s), "b" if s < 40 else "a") for s in range(0, 180, 2)]
    df = spark.createDataFrame(rows, "subject int, video int, window_start_ms long, x double, label string")
    got = {r["macro"]: r for r in windows.macro_windows(df, 120, 60, ["x"]).collect()}
    assert sorted(got) == [0, 1, 2]
    assert [got[i]["n_windows"] for i in (0, 1, 2)] == [60, 60, 30]
    assert got[2]["x"] == pytest.approx(np.mean(range(120, 180, 2)))
    assert got[0]["label"] == "a"


def test_window_tensor_drops_poor_channels(spark):
    rows = [(w, t, float(t), None if w == 2 and t > 0 else 2.0 * t) for w in (1, 2) for t in range(0, 100, 10)]
    df = spark.createDataFrame(rows, "w int, t long, a double, b double").withColumn("win_start", F.lit(0))
    grid = windows.window_grid(df, ["w"], ["a", "b"], 100, 5, width=30)
    got = windows.window_tensor(grid, ["w"], ["a", "b"]).collect()
    assert [r["w"] for r in got] == [1]
    assert got[0]["x"] == [[0, 20, 40, 60, 80], [0, 40, 80, 120, 160]]
    picked = project.select_channels(windows.window_tensor(grid, ["w"], ["a", "b"]), ["a", "b"], ["b"])
    assert one(picked)["x"] == [[0, 40, 80, 120, 160]]


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_normalize_curve_equals_numpy(spark, n):
    y = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "t": range(n), "y": y}))
    got = windows.normalize_curve(df, ["g"], "y", 25, width=6).toPandas().sort_values("point")["value"]
    np.testing.assert_allclose(got, np.interp(np.linspace(0, 1, 25), np.linspace(0, 1, n) if n > 1 else [0.0], y), atol=1e-12)


def test_statistics_of_a_constant(spark):
    df = spark.createDataFrame([(1, t, 3.0) for t in range(5)], "g int, t long, y double")
    df = S.with_neighbours(df, ["g"], ["y"], width=2)
    spec = ["mean", "std0", "std1", "slope", "slope_fs", "skew", "kurtosis", "diff_mean", "zero_crossings", "mad"]
    r = one(S.stats(df, ["g"], ["y"], spec))
    assert (r["y_mean"], r["y_std0"], r["y_std1"], r["y_slope"], r["y_slope_fs"]) == (3, 0, 0, 0, 0)
    assert (r["y_skew"], r["y_kurtosis"], r["y_zero_crossings"], r["y_mad"]) == (0, -3, 0, 0)
    short = spark.createDataFrame([(1, 0, 3.0), (1, 1, 4.0)], "g int, t long, y double")
    r = one(S.stats(S.with_neighbours(short, ["g"], ["y"], width=2), ["g"], ["y"], ["skew", "kurtosis", "slope_fit", "breath_rate"]))
    assert (r["y_skew"], r["y_kurtosis"], r["y_slope_fit"], r["y_breath_rate"]) == (None, None, None, 0.0)


def test_statistics_equal_numpy_and_ignore_missing(spark):
    y = np.random.default_rng(4).normal(size=200)
    rows = [(1, i, float(v)) for i, v in enumerate(y)] + [(1, 200, NAN), (1, 201, INF), (1, 202, None)]
    df = S.with_neighbours(spark.createDataFrame(rows, "g int, t long, y double"), ["g"], ["y"], width=17)
    spec = ["n", "mean", "std0", "std1", "median", "iqr", "range", "skew", "kurtosis", "auc", "slope_fit",
            "diff_mean", "diff_std0", "diff_positive", "zero_crossings", "mad"]
    r = one(S.stats(df, ["g"], ["y"], spec, fs=4.0))
    d, c = np.diff(y) * 4, y - y.mean()
    want = {
        "n": 200, "mean": y.mean(), "std0": y.std(), "std1": y.std(ddof=1), "median": np.median(y),
        "iqr": np.subtract(*np.percentile(y, [75, 25])), "range": np.ptp(y), "skew": (c**3).mean() / y.std() ** 3,
        "kurtosis": (c**4).mean() / y.var() ** 2 - 3, "auc": np.trapezoid(y, dx=0.25),
        "slope_fit": np.polyfit(range(200), y, 1)[0], "diff_mean": d.mean(), "diff_std0": d.std(),
        "diff_positive": (d > 0).mean(), "zero_crossings": (np.signbit(c[1:]) != np.signbit(c[:-1])).sum() / 50,
        "mad": np.median(np.abs(y - np.median(y))),
    }
    for name, value in want.items():
        assert r[f"y_{name}"] == pytest.approx(value, abs=1e-9), name


def test_sine_gives_its_rate(spark):
    t = np.arange(0, 10, 0.01)
    y = np.sin(2 * np.pi * 1.2 * t) + np.random.default_rng(0).normal(scale=0.2, size=len(t))
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "t": t, "y": y}))
    got = one(signal.band_peak(df, "y", ["g"], F.col("t"), 0.7, 3.5, 0.01, signal.hann(F.col("t") / 10)))
    assert got["per_min"] == pytest.approx(72.0, abs=0.7)


def test_poincare_and_hrv(spark):
    rr = np.array([800.0, 850, 790, 900, 820, 805])
    beats = np.concatenate([[0], np.cumsum(rr)]).astype(int)
    df = spark.createDataFrame([(1, int(b)) for b in beats], "g int, idx long")
    r = one(signal.hrv_time(signal.ibi(df, ["g"], fs=1000.0, scale=1000.0, width=1000), ["g"], ddof=1, as_percent=False))
    d = np.diff(rr)
    assert r["ibi_mean"] == pytest.approx(rr.mean())
    assert r["sdnn"] == pytest.approx(rr.std(ddof=1))
    assert r["rmssd"] == pytest.approx(np.sqrt((d**2).mean()))
    assert r["pnn50"] == pytest.approx((abs(d) > 50).mean())
    assert r["sd1"] == pytest.approx(math.sqrt(0.5) * d.std(ddof=1))
    assert r["sd2"] == pytest.approx(math.sqrt(2 * rr.var(ddof=1) - 0.5 * d.var(ddof=1)))


def test_va_rectangle_boundaries(spark):
    axis = [3.9, 4.0, 5.0, 6.0, 6.1]
    rows = [(v, a) for v in axis for a in axis] + [(NAN, 5.0), (5.0, None)]
    got = {(r["v"], r["a"]): r["l"] for r in spark.createDataFrame(rows, "v double, a double").withColumn("l", L.va_label("v", "a")).collect()}
    inner = [4.0, 5.0, 6.0]
    assert all(got[v, a] == "neutral" for v in inner for a in inner)
    assert got[3.9, 6.1] == "scary" and got[3.9, 3.9] == "bored" and got[6.1, 6.1] == "amused" and got[6.1, 3.9] == "relaxed"
    assert got[6.1, 5.0] == "amused" and got[6.1, 4.0] == "relaxed" and got[3.9, 5.0] == "scary" and got[3.9, 4.0] == "bored"
    assert got[5.0, 6.1] == "amused" and got[4.0, 6.1] == "scary" and got[5.0, 3.9] == "relaxed" and got[4.0, 3.9] == "bored"
    assert got[5.0, None] == "neutral" and sum(x == "neutral" for x in got.values()) == 11


def test_display_names(spark):
    rows = [(n,) for n in ("Scary 2", "Amusing 1", "bluVid")]
    got = {r["n"]: (r["c"], r["v"]) for r in spark.createDataFrame(rows, "n string").select("n", L.category_of("n").alias("c"), L.variant_of("n").alias("v")).collect()}
    assert got == {"Scary 2": ("Scary", 2), "Amusing 1": ("Amusing", 1), "bluVid": ("bluVid", 1)}


def test_scalar_rules(spark):
    df = spark.createDataFrame([("7.5", NAN, 3.0), ("x", INF, -1.0), (None, None, 0.0)], "s string, a double, b double")
    got = df.select(
        to_numeric("s").alias("n"), finite("a").alias("f"), clip("b", -0.5, 2).alias("c"), first_valid("a", "b").alias("v")
    ).collect()
    assert [r["n"] for r in got] == [7.5, None, None]
    assert [r["f"] for r in got] == [None, None, None]
    assert [r["c"] for r in got] == [2.0, -0.5, 0.0]
    assert [r["v"] for r in got] == [3.0, None, None]


def test_channel_sets():
    names = ["ecg", "bvp", "gsr", "rsp", "skt", "emg_zygo", "emg_coru", "emg_trap"]
    sets = project.channel_sets(names)
    assert sets["no_ecg"] == names[1:]
    assert sets["no_gsr"] == [n for n in names if n != "gsr"]
    assert sets["face"] == ["emg_zygo", "emg_coru"]
    assert sets["combined"] == ["ecg", "gsr", "rsp", "skt"]
    assert "no_emg" not in project.channel_sets(["ecg", "gsr"])
    assert "no_emg" not in project.channel_sets(["emg_zygo"])


def test_filters_keep_unknown_rows(spark):
    df = spark.createDataFrame([(1, "Start"), (10, None), (None, "amused")], "video int, label string")
    assert project.exclude_videos(df, [10]).count() == 2
    assert project.exclude_labels(df, ["START"]).count() == 2


def test_cleaning_rules(spark):
    df = spark.createDataFrame([(1.0, None, 2.0, 5.0), (NAN, None, 2.0, None), (INF, NAN, 2.0, 5.0)], "a double, b double, c double, d double")
    cols = ["a", "b", "c", "d"]
    assert clean.empty_columns(df, cols) == ["b"]
    assert clean.constant_columns(df, cols) == ["b", "c"]  # d has a missing value, which counts
    assert [r["a"] for r in clean.clean(df, ["a"]).collect()] == [1.0, 0.0, 0.0]


def test_quantile_normalizer_against_normal_distribution(spark):
    x = np.random.default_rng(2).exponential(size=2000)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = clean.QuantileNormalizer(["x"], 300).fit(df).transform(df.withColumn("raw", F.col("x"))).toPandas()
    knots, probs = np.percentile(x, np.linspace(0, 100, 300)), np.linspace(0, 1, 300)
    p = np.clip(np.interp(got["raw"], knots, probs), 1e-7, 1 - 1e-7)
    want = [st.NormalDist().inv_cdf(v) for v in p]
    np.testing.assert_allclose(got["x"], want, atol=1e-6)


def test_downsample_rules(spark):
    rows = [(i, "a") for i in range(50)] + [(100 + i, "b") for i in range(10)] + [(200 + i, "c") for i in range(21)]
    df = spark.createDataFrame(rows, "window_id long, label string")
    count = lambda d: {r["label"]: r["count"] for r in d.groupBy("label").count().collect()}
    assert count(clean.downsample_class(df, "a", "median")) == {"a": 15, "b": 10, "c": 21}
    assert count(clean.downsample_class(df, "a", "min")) == {"a": 10, "b": 10, "c": 21}
    assert clean.downsample_class(df, "b") is df and clean.downsample_class(df, "none") is df
    again = clean.downsample_class(df.repartition(7), "a", "min")
    assert set(map(tuple, again.collect())) == set(map(tuple, clean.downsample_class(df, "a", "min").collect()))


def test_zscore_modes(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 1.0), (2, 3.0)], "g int, y double")
    for mode, flat in (("zero", 0.0), ("center", 0.0), ("unit", 0.0)):
        got = signal.zscore(df, ["y"], ["g"], mode).orderBy("g", "y").toPandas()["y_z"].tolist()
        assert got == [flat, flat, -1.0, 1.0]

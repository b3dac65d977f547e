"""Ordered scans and quantiles must not depend on how series are cut or distributed."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from physio_spark.operators.align import asof_join, interp_join, interval_agg, shift_labels
from physio_spark.operators.ordered import attach, chunk_width, ranked, scan
from physio_spark.operators.quantiles import bracketed_quantiles, mode_of
from physio_spark.operators.signal import fill_linear, peaks, rolling_mean
from physio_spark.runtime import prepare


def series(n=400, groups=3, seed=0):
    """Uneven series; the first one holds most of the rows."""
    rng = np.random.default_rng(seed)
    frames = []
    for g in range(groups):
        size = n if g == 0 else n // (4 * g)
        t = np.sort(rng.choice(5000, size, replace=False))
        frames.append(pd.DataFrame({"subject": g, "t": t, "value": rng.normal(size=size).round(3)}))
    return pd.concat(frames, ignore_index=True)


@pytest.mark.parametrize("width", [7, 100, 10_000])
def test_scan_matches_pandas(spark, width):
    pdf = series()
    pdf["maybe"] = pdf["value"].where(pdf["value"] > 0.8)
    maybe = F.when(~F.isnan("maybe"), F.col("maybe"))
    df = spark.createDataFrame(pdf).repartition(5)
    got = scan(
        df, ["subject"], ["t"], width,
        prev={"p": F.col("value")}, following={"f": F.col("value")}, last={"l": maybe}, ahead={"a": maybe},
        running={"r": F.col("value")}, index="i",
        whole={"n": ("sum", F.lit(1)), "lo": ("min", F.col("value"))},
    ).toPandas().sort_values(["subject", "t"], ignore_index=True)
    g = pdf.groupby("subject")
    for name, want in {
        "p": g["value"].shift(1), "f": g["value"].shift(-1), "l": g["maybe"].ffill(), "a": g["maybe"].bfill(),
        "r": g["value"].cumsum(), "i": g.cumcount(), "n": g["value"].transform("size"), "lo": g["value"].transform("min"),
    }.items():
        np.testing.assert_allclose(got[name].astype(float), want.astype(float), atol=1e-9, err_msg=name)


def test_chunk_width_bounds_the_fullest_chunk(spark):
    df = spark.createDataFrame(series(1000, 2))
    width = chunk_width(df, ["subject"], "t", 5000, target=50)
    fullest = df.groupBy("subject", F.floor(F.col("t") / width)).count().agg(F.max("count")).first()[0]
    assert fullest <= 50
    assert chunk_width(df, ["subject"], "t", 5000, target=10_000) == 5000


@pytest.mark.parametrize("width", [50, 100_000])
def test_interp_join_equals_numpy(spark, width):
    left, right = series(300, 2, 1), series(60, 2, 2).rename(columns={"value": "valence"})
    got = interp_join(
        spark.createDataFrame(left), spark.createDataFrame(right), cols=["valence"], width=width
    ).toPandas().sort_values(["subject", "t"])
    for g, part in got.groupby("subject"):
        knots = right[right["subject"] == g]
        want = np.interp(part["t"], knots["t"], knots["valence"])
        np.testing.assert_allclose(part["valence"].to_numpy(), want, atol=1e-12)


def test_phantom_ids_only_in_compat_mode(spark):
    left = spark.createDataFrame([(1, t) for t in range(0, 11)], "subject int, t long")
    right = spark.createDataFrame([(1, 0, 3), (1, 10, 8)], "subject int, t long, video int")
    near = interp_join(left, right, cols=[], round_cols=["video"], width=4).toPandas()
    compat = interp_join(left, right, cols=[], round_cols=["video"], round_mode="compat", width=4).toPandas()
    assert set(near["video"]) == {3, 8}
    assert set(compat["video"]) == {3, 4, 5, 6, 7, 8}


def test_shift_drops_the_tail_and_zero_is_identity(spark):
    df = spark.createDataFrame([(1, t, float(t), -float(t)) for t in range(10)], "subject int, t long, valence double, arousal double")
    got = shift_labels(df, 3, width=4).toPandas().sort_values("t")
    assert got["t"].tolist() == list(range(7))
    assert got["valence"].tolist() == [float(t + 3) for t in range(7)]
    assert shift_labels(df, 0, width=4) is df
    assert shift_labels(df, 50, width=4).count() == 0


def test_asof_directions(spark):
    left = spark.createDataFrame([(1, 5), (1, 20)], "g int, t long")
    right = spark.createDataFrame([(1, 3, 30), (1, 5, 50), (1, 9, 90)], "g int, t long, v int")
    back = {r["t"]: r["v"] for r in asof_join(left, right, ["g"], "t", ["v"], width=4).collect()}
    ahead = {r["t"]: r["v"] for r in asof_join(left, right, ["g"], "t", ["v"], width=4, direction="forward").collect()}
    assert back == {5: 50, 20: 90}
    assert ahead == {5: 50, 20: None}


def test_interval_agg_is_closed_on_both_ends(spark):
    w = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (1, 50, 60)], "subject int, start long, end long")
    p = spark.createDataFrame([(1, 0, 1.0, 4), (1, 10, 3.0, 4), (1, 20, 5.0, 2)], "subject int, t long, valence double, video int")
    got = {r["start"]: r for r in interval_agg(w, p, means=["valence"], mode="video", width=7).collect()}
    assert (got[0]["valence"], got[0]["n_points"], got[0]["video_mode"]) == (2.0, 2, 4)
    assert (got[10]["valence"], got[10]["video_mode"]) == (4.0, 2)
    assert (got[50]["valence"], got[50]["n_points"]) == (None, 0)


def test_bracketed_quantiles_equal_numpy(spark):
    pdf = series(3000, 3, 5)
    pdf.loc[pdf.index % 3 == 0, "value"] = 0.5  # a third of the rows share one value
    got = bracketed_quantiles(
        spark.createDataFrame(pdf), ["subject"], {"a": ("value", 0.1), "b": ("value", 0.5), "c": ("value", 0.99)}, accuracy=200
    ).toPandas().set_index("subject")
    assert len(got) == 3
    nothing = spark.createDataFrame([(1, None), (2, 3.0)], "g int, v double")
    few = {r["g"]: r["m"] for r in bracketed_quantiles(nothing, ["g"], {"m": ("v", 0.5)}).collect()}
    assert few == {1: None, 2: 3.0}
    for g, part in pdf.groupby("subject"):
        np.testing.assert_allclose(got.loc[g, ["a", "b", "c"]], np.percentile(part["value"], [10, 50, 99]), atol=1e-12)


def test_mode_ties_and_default(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (3, "z"), (3, "z"), (3, "a")], "g int, v string")
    got = {r["g"]: r["m"] for r in mode_of(df, ["g"], "v", "m", default="bored").collect()}
    assert got == {1: "a", 2: "bored", 3: "z"}


def test_attach_salted_equals_plain(spark):
    df = spark.createDataFrame(series())
    table = df.groupBy("subject").agg(F.sum("value").alias("s"))
    plain = attach(df, table, ["subject"]).toPandas().sort_values(["subject", "t"], ignore_index=True)
    salted = attach(df, table, ["subject"], salts=8).toPandas().sort_values(["subject", "t"], ignore_index=True)
    pd.testing.assert_frame_equal(plain, salted[plain.columns])


def test_ranked_is_a_permutation(spark):
    df = spark.range(1000).withColumn("h", F.md5(F.col("id").cast("string")))
    part = F.conv(F.substring("h", 1, 2), 16, 10).cast("int")
    got = ranked(df, [], [F.col("h")], "r", part).orderBy("r").toPandas()
    assert got["r"].tolist() == list(range(1, 1001))
    assert got["h"].is_monotonic_increasing


@pytest.mark.parametrize("size", [1, 2, 5, 8])
@pytest.mark.parametrize("chunk", [20, 10_000])
def test_rolling_mean_edges(spark, size, chunk):
    x = np.random.default_rng(1).normal(size=97)
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "idx": range(97), "x": x}))
    got = rolling_mean(df, "x", size, ["g"], out="m", chunk=chunk).toPandas().sort_values("idx")["m"].to_numpy()
    full = np.convolve(x, np.ones(size) / size, "valid")
    want = np.concatenate([np.full(size // 2, full[0]), full, np.full(97 - len(full) - size // 2, full[-1])])
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_fill_linear_holds_the_ends(spark):
    values = [None, 1.0, None, None, 4.0, float("nan"), float("inf")]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "g int, idx long, x double")
    got = fill_linear(df, ["x"], ["g"], width=2).toPandas().sort_values("idx")["x"].tolist()
    assert got == pytest.approx([1, 1, 2, 3, 4, 4, 4])


def greedy(x, k, dist, strict):
    z = (x - x.mean()) / x.std()
    kept = []
    for i in range(1, len(x) - 1):
        top = z[i] > k and z[i] > z[i - 1] and (z[i] > z[i + 1] if strict else z[i] >= z[i + 1])
        if top and (not kept or i - kept[-1] >= dist):
            kept.append(i)
    return kept


@pytest.mark.parametrize("chunk", [10, 64, 100_000])
@pytest.mark.parametrize("dist", [1, 4, 9])
def test_threshold_peaks_equal_brute_force(spark, chunk, dist):
    x = np.random.default_rng(7).normal(size=600).round(1)
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "t": range(600), "x": x}))
    for strict in (False, True):
        got = peaks(df, "x", ["g"], k=0.2, min_dist=dist, strict=strict, width=40, chunk=chunk).toPandas()
        assert sorted(got["idx"]) == greedy(x, 0.2, dist, strict)


def tallest(x, dist):
    c, i = [], 1
    while i < len(x) - 1:
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if x[i] > x[i - 1] and j + 1 < len(x) and x[j + 1] < x[i]:
            c.append((i + j) // 2)
        i = j + 1
    kept: list[int] = []
    for i in sorted(c, key=lambda i: (x[i], i), reverse=True):
        if all(abs(i - j) >= dist for j in kept):
            kept.append(i)
    return sorted(kept)


@pytest.mark.parametrize("chunk", [12, 100_000])
def test_distance_peaks_equal_brute_force(spark, chunk):
    rng = np.random.default_rng(3)
    ramp = np.cumsum(np.abs(rng.normal(size=120))) + np.tile([0, 5], 60)  # long chains of ever higher peaks
    for x in (rng.normal(size=300).round(1), ramp):
        df = spark.createDataFrame(pd.DataFrame({"g": 1, "t": range(len(x)), "x": x}))
        got = peaks(df, "x", ["g"], min_dist=5, mode="distance", width=40, chunk=chunk).toPandas()
        assert sorted(got["idx"]) == tallest(x, 5)


@pytest.mark.parametrize("width", [1, 3, 50, 10_000])
def test_blocks_do_not_depend_on_chunks(spark, width):
    from physio_spark.operators.segment import blocks

    pdf = series(200, 2, 9)
    pdf["video"] = np.random.default_rng(1).integers(0, 2, len(pdf)) // 1
    pdf["video"] = (pdf["t"] // 37 + pdf["video"] * (pdf["t"] > 3000)) % 3
    got = blocks(spark.createDataFrame(pdf), width=width).toPandas().sort_values(["subject", "t"], ignore_index=True)
    change = (pdf["video"] != pdf.groupby("subject")["video"].shift()).astype(int)
    pdf["block"] = change.groupby(pdf["subject"]).cumsum()
    run = pdf.groupby(["subject", "block"])["t"]
    np.testing.assert_array_equal(got["block"], pdf["block"])
    np.testing.assert_array_equal(got["block_start"], run.transform("min"))
    np.testing.assert_array_equal(got["block_end"], run.transform("max"))


def test_tasks_of_a_scan_read_little(spark):
    """200 MB over 8 cores: a task reads 8 MB of them, not an eighth of whatever there is."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    prepare(spark).conf.set("spark.sql.shuffle.partitions", "64")
    try:
        noise = F.concat(*[F.sha2(F.concat_ws("-", "id", F.lit(i)), 256) for i in range(4)])
        df = spark.range(800_000).select(F.col("id").alias("t"), (F.col("id") % 500).alias("s"), noise.alias("noise"))
        rows = scan(df, ["s"], ["t"], 100_000, last={"before": F.col("noise")})
        tasks = rows.where("length(before) = 256").groupBy(F.spark_partition_id()).count()
        assert tasks.agg(F.max("count")).first()[0] <= 50_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

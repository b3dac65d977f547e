"""Spectra, variability and ratings of many windows, against plain arithmetic."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from physio_spark.operators import align, panes
from physio_spark.operators import signal as G

BAND = (0.2, 1.5, 0.1)


def pulse(n, subjects=("a", None)):
    rng = random.Random(5)
    rows = [(s, i, math.sin(0.9 * i * (1 + i / n)) + rng.gauss(0, 0.5), 0, n) for s in subjects for i in range(n)]
    rows = [(s, i, None if rng.random() < 0.05 or 500 <= i < 560 else float("nan") if i == 7 else v, z, e) for s, i, v, z, e in rows]
    return rows, "subject string, idx long, x double, _zero long, _total long"


def strongest(values, fs, size):
    """Per minute, by the definition; None if there are too few samples."""
    at = np.array([i for i, v in enumerate(values) if v is not None and v == v])
    if len(at) < 4:
        return None
    y = np.array([values[i] for i in at])
    y = (y - y.mean()) * (0.5 - 0.5 * np.cos(2 * math.pi * at / size))
    grid = G.frequency_grid(*BAND)
    return grid[int(np.argmax([abs((y * np.exp(2j * math.pi * f * at / fs)).sum()) for f in grid]))] * 60.0


@pytest.mark.parametrize(("size", "hop"), [(48, 4), (40, 60)])
def test_spectra_over_many_stretches(spark, size, hop):
    n, fs = 1500, 4.0
    rows, schema = pulse(n)
    got = panes.window_band_peaks(spark.createDataFrame(rows, schema), "x", ["subject"], size, hop, fs, {"rate": BAND}).collect()
    values = {s: [r[2] for r in rows if r[0] == s] for s in ("a", None)}
    held = lambda own: any(v is not None and v == v for v in own)
    want = {(s, w): strongest(own, fs, size) for s, x in values.items() for w in range((n - size) // hop + 1) if held(own := x[w * hop : w * hop + size])}
    assert {(r["subject"], r["win"]): r["rate"] for r in got} == want
    assert len(got) == len(want) and None in want.values() or hop == 60


def test_a_long_window_is_worked_on_in_parts(spark, monkeypatch):
    rows, schema = pulse(1500, ("a",))
    run = lambda: {r["win"]: r["rate"] for r in panes.window_band_peaks(spark.createDataFrame(rows, schema), "x", ["subject"], 100, 5, 4.0, {"rate": BAND}).collect()}
    whole = run()
    monkeypatch.setattr(panes, "VALUES", 250)
    assert run() == whole and len(whole) == 281


def test_spectra_shuffle_the_samples_not_their_waves(spark):
    rows, schema = pulse(200, ("a",))
    out = panes.window_band_peaks(spark.createDataFrame(rows, schema), "x", ["subject"], 26, 4, 1.3, {"rate": BAND})
    plan = out._jdf.queryExecution().sparkPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("\n\n")[0].count("HashAggregate") == 0
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_variability_of_small_groups_in_one_pass(spark):
    rng = random.Random(2)
    rows = [(i % 40, float(rng.choice([700, 800, 900, 1000]) + i % 3), rng.gauss(0, 60) if i % 7 else None) for i in range(400)]
    rows += [(50, 800.0, None), (51, None, None)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["g", "ibi", "ibi_diff"]).astype(object).where(lambda d: d.notna(), None), "g int, ibi double, ibi_diff double")
    measured = G.hrv_time(df, ["g"], ddof=1, as_percent=False).toPandas().set_index("g").sort_index()
    gathered = G.hrv_time(df, ["g"], ddof=1, as_percent=False, max_rows=None, also=[F.max("ibi").alias("top")])
    assert gathered._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    gathered = gathered.toPandas().set_index("g").sort_index()
    pd.testing.assert_frame_equal(gathered[measured.columns], measured)
    assert gathered.loc[50, "top"] == 800


def test_intervals_are_copied_only_for_crowded_buckets(spark, monkeypatch):
    windows = spark.createDataFrame([(s, i * 50, i * 50 + 120) for s in range(3) for i in range(30)], "subject int, start long, end long")
    points = spark.createDataFrame([(s, t, float(t % 13), float(t)) for s in range(3) for t in range(0, 1500, 3)], "subject int, t long, valence double, arousal double")
    run = lambda salts: sorted(map(tuple, align.interval_agg(windows, points, width=200, salts=salts).collect()))
    want = run(8)
    assert run(None) == want
    monkeypatch.setattr(align, "CROWDED", 10)
    assert run(None) == want

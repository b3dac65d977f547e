"""The regression forest that tasks grow."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from physio_spark.operators import forest, models

NAMES = [f"f{i}" for i in range(6)]


def table(n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(NAMES)))
    x[:, 5] = x[:, 5] > 1
    y = np.rint(10 * (2 * x[:, 0] + 3 * np.abs(x[:, 1]) + 2 * x[:, 5]))
    return pd.DataFrame(x, columns=NAMES).assign(y=y, _row=np.arange(n), fold=np.arange(n) % 3)


def told(df):
    return df.toPandas().set_index("_row")["prediction"].sort_index()


def test_no_regression_tree_is_fitted_by_the_driver(spark, monkeypatch):
    monkeypatch.setattr(RandomForestRegressor, "_fit", lambda *_: pytest.fail("the driver would hold the trees"))
    pdf = table()
    out = models.oof_regress(spark.createDataFrame(pdf), ["y"], NAMES, "forest", trees=10).toPandas()
    assert list(out.columns) == [*pdf.columns, "pred_y"] and len(out) == 600
    assert out.sort_values("_row")["f0"].tolist() == pdf["f0"].tolist()
    assert np.corrcoef(out["y"], out["pred_y"])[0, 1] > 0.9


def test_a_forest_is_the_same_in_large_and_small_tasks(spark):
    df = spark.createDataFrame(table()).select("_row", "fold", F.col("y").alias("_y"), F.array(*NAMES).alias("_v"))
    train, rows = df.where("fold > 0").cache(), df.where("fold = 0")
    whole = told(forest.predict(train, rows, len(NAMES), trees=5, n=400))
    parted = told(forest.predict(train.repartition(5), rows, len(NAMES), trees=5, n=400, task_rows=50))
    assert len(whole) == 200 and whole.to_numpy() == pytest.approx(parted.to_numpy())
    other = told(forest.predict(train, rows, len(NAMES), trees=5, n=400, seed=1))
    assert (whole - other).abs().max() > 1


def test_a_tree_takes_the_largest_drop_of_the_variance():
    rng = np.random.default_rng(1)
    codes, y, counts = rng.integers(0, 8, (60, 4)).astype(np.uint8), rng.normal(size=60), rng.integers(1, 4, 60)

    def spread(at):
        return (counts[at] * (y[at] - np.average(y[at], weights=counts[at])) ** 2).sum() if len(at) else 0.0

    def walk(at, level):
        """Leaves of the greedy tree, found by trying every split."""
        best = (1e-12, None)
        for j in range(4 if level < 6 else 0):
            for cut in range(7):
                left, right = at[codes[at, j] <= cut], at[codes[at, j] > cut]
                if min(counts[left].sum(), counts[right].sum()) >= 3:
                    best = max(best, (spread(at) - spread(left) - spread(right), (left, right)), key=lambda x: x[0])
        if best[1] is None:
            return {i: np.average(y[at], weights=counts[at]) for i in at}
        return walk(best[1][0], level + 1) | walk(best[1][1], level + 1)

    tree = forest.grow(codes, y, counts, (0, 1), 6, 3, 4, 42)
    want = walk(np.arange(60), 0)
    assert forest.apply(tree, codes).tolist() == pytest.approx([want[i] for i in range(60)])


def test_thresholds_come_from_all_rows(spark):
    n = 20_000
    df = spark.range(n, numPartitions=3).select(F.array(F.col("id") / 1.0, (F.col("id") % 3).cast("double"), F.lit(1.0)).alias("_v"))
    even, few, constant = forest.thresholds(df, 3)
    assert len(even) == 31 and np.abs(even - n * np.arange(1, 32) / 32).max() < n / 500
    assert few.tolist() == [0.5, 1.5] and not len(constant)


def test_few_known_targets_and_bootstrap_counts(spark):
    pdf = table(30).assign(z=[1.0] * 3 + [None] * 27)
    out = models.oof_regress(spark.createDataFrame(pdf), ["z", "y"], NAMES, "forest", trees=3).toPandas()
    assert len(out) == 30 and out["pred_z"].isna().all() and out["pred_y"].notna().all()
    drawn = forest.bootstrap(1, 2, np.arange(100_000))
    assert drawn.mean() == pytest.approx(1, abs=0.02) and (drawn == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)

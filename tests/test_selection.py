"""Selection by hash and quantiles of many columns, against plain sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from physio_spark.functions.columns import portable_hash
from physio_spark.operators import ordered
from physio_spark.operators.quantiles import bracketed_quantiles


@pytest.mark.parametrize("n", [0, 1, 7, 60, 10_000])
def test_smallest_hashes_of_every_group(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice("aaab") if i % 11 else None, i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, k long").repartition(5)
    h = portable_hash(3, "k")
    for by in (["g"], []):
        got = ordered.smallest(df, by, h, n, ["k"])
        assert got.columns == ["g", "k", "_chosen"]
        out = [(r["g"] if by else None, r["h"], r["_chosen"]) for r in got.withColumn("h", h).collect()]
        assert len(out) == 400
        for group in {g for g, _, _ in out}:
            own = sorted(x for x in out if x[0] == group) if group is not None else sorted((x for x in out if x[0] is None), key=lambda x: x[1])
            assert [c for _, _, c in own] == [i < n for i in range(len(own))]


def test_rows_of_one_hash_are_counted_out(spark):
    df = spark.createDataFrame([(1,)] * 50 + [(2,)] * 50, "k long")
    got = ordered.smallest(df, [], portable_hash(1, "k"), 60, ["k"]).where("_chosen").groupBy("k").count().collect()
    assert sorted(r["count"] for r in got) == [10, 50]


def test_only_bins_are_ordered_before_the_cut(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    plan = ordered.smallest(df, [], portable_hash(1, "k"), 100)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 1  # the rows that share 32 bits with the last one
    assert "_left1" in plan


def test_numbers_follow_the_order(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("x")).repartition(13)
    got = ordered.numbered(df, [F.desc("x")], "at").collect()
    want = {x: i for i, x in enumerate(sorted((r["x"] for r in got), reverse=True))}
    assert all(want[r["x"]] == r["at"] for r in got)


@pytest.mark.parametrize("by", [["g"], []])
def test_quantiles_of_many_columns_in_two_passes(spark, by):
    rng = np.random.default_rng(2)
    rows = [(i % 3, float(rng.normal()), None if i % 5 == 0 else float(rng.integers(0, 4)), float(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "g int, x double, y double, z double")
    specs = {"a": ("x", 0.5), "b": ("y", 0.25), "c": ("y", 0.9), "d": (F.col("z") * 2, 0.5), "e": ("x", 0.0)}
    got = {r["g"] if by else 0: r for r in bracketed_quantiles(df, by, specs, accuracy=50).collect()}
    for key in ({0, 1, 2} if by else {0}):
        own = [r for r in rows if not by or r[0] == key]
        x, y, z = ([r[i] for r in own if r[i] is not None] for i in (1, 2, 3))
        want = {"a": np.quantile(x, 0.5), "b": np.quantile(y, 0.25), "c": np.quantile(y, 0.9), "d": 2 * np.quantile(z, 0.5), "e": min(x)}
        assert {n: got[key][n] for n in want} == pytest.approx(want)
    few, many = (
        bracketed_quantiles(df, by, {f"q{i}": (F.col("x") * i, 0.5) for i in range(n)})._jdf.queryExecution().optimizedPlan().toString()
        for n in (1, 8)
    )
    assert few.count("LogicalRDD") == many.count("LogicalRDD") <= 2


def test_many_quantiles_of_a_large_group(spark):
    """The three hundred knots of the normalizer, over groups that are bracketed; ties, a group without a value."""
    from physio_spark.operators.clean import QuantileNormalizer

    rng = np.random.default_rng(7)
    rows = [(float(rng.exponential()), float(rng.integers(0, 50))) for _ in range(3000)] + [(None, None)]
    df = spark.createDataFrame(rows, "x double, y double")
    fitted = QuantileNormalizer(["x", "y"], max_rows=100).fit(df)
    for i, c in enumerate(("x", "y")):
        want = np.quantile([r[i] for r in rows[:-1]], np.linspace(0, 1, 300))
        np.testing.assert_allclose(fitted.knots[c], want, atol=1e-12)
    groups = spark.createDataFrame([(None, 1.0), (None, 2.0), (1, 5.0), (2, None)], "g int, x double")
    specs = {f"q{i}": ("x", i / 299) for i in range(300)}
    got = {r["g"]: r for r in bracketed_quantiles(groups, ["g"], specs, accuracy=50).collect()}
    assert (got[None]["q0"], got[None]["q299"], got[1]["q150"], got[2]["q7"]) == (1.0, 2.0, 5.0, None)


def test_quantiles_of_few_groups_leave_the_rows_where_they_are(spark, monkeypatch):
    from physio_spark.operators import clean, quantiles

    def no_shuffle(*_):
        raise AssertionError("rows were joined by their group")

    df = spark.createDataFrame([(float(i % 97),) for i in range(500)] + [(None,)], "x double")
    monkeypatch.setattr(quantiles, "attach", no_shuffle)
    assert clean.MedianImputer(["x"], max_rows=100).fit(df).medians == {"x": float(np.median([i % 97 for i in range(500)]))}
    monkeypatch.undo()
    monkeypatch.setattr(quantiles, "BROADCAST_EDGES", 0)  # groups too many to be sent
    assert clean.MedianImputer(["x"], max_rows=100).fit(df).medians == {"x": float(np.median([i % 97 for i in range(500)]))}

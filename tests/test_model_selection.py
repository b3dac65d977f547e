"""Prepared folds, search, selection and permutation importance against plain computations."""

import threading
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from physio_spark.operators import balance, models, splits
from physio_spark.operators.clean import MedianImputer, QuantileNormalizer, StandardScaler
from physio_spark.operators.evaluate import classification_metrics
from physio_spark.runtime import concurrently, materialize

COLS = list("pqrs")


def blobs(n=240, seed=0):
    rng = np.random.default_rng(seed)
    label = rng.choice(3, n, p=(0.5, 0.35, 0.15))
    x = rng.normal(size=(n, 4)) + np.eye(3, 4)[label] * 4
    pdf = pd.DataFrame(x, columns=COLS)
    pdf.loc[rng.random(n) < 0.1, "q"] = np.nan
    return pdf.assign(window_id=range(n), subject=rng.integers(0, 12, n), label=[f"c{v}" for v in label])


@pytest.fixture(scope="module")
def folded(spark):
    return materialize(splits.group_kfold(spark.createDataFrame(blobs()), "subject", 3))


@pytest.mark.parametrize("options", [{}, {"scale": True}, {"normalize": True, "scale": True}])
def test_folds_are_prepared_by_their_training_rows(folded, options):
    ready = models.prepare_folds(folded, COLS, keep=["window_id"], **options)
    assert sorted(ready.parts) == [1, 2, 3]
    for f, parts in ready.parts.items():
        train, val = folded.where(F.col("fold") != f), folded.where(F.col("fold") == f)
        steps = [MedianImputer(COLS)] + [QuantileNormalizer(COLS)] * ("normalize" in options) + [StandardScaler(COLS)] * ("scale" in options)
        for step in steps:
            step.fit(train)
            train, val = step.transform(train), step.transform(val)
        for got, want in zip(parts, (train, val), strict=True):
            a, b = (x.select("window_id", *COLS).toPandas().sort_values("window_id").to_numpy() for x in (got, want))
            assert np.allclose(a, b)


def test_partners_are_a_permutation_in_every_repeat(spark):
    keys = spark.range(500).select((F.col("id") * 7 - 3).alias("k"))
    rows = models.partner_rows(keys.repartition(9), "k", 3, seed=5).collect()
    again = models.partner_rows(keys.coalesce(1), "k", 3, seed=5).collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in again}
    want = sorted(7 * i - 3 for i in range(500))
    moves = {}
    for r in (1, 2, 3):
        own = {x["k"]: x["partner"] for x in rows if x["repeat"] == r}
        assert sorted(own) == want
        assert sorted(own.values()) == want
        assert sum(a == b for a, b in own.items()) < 10
        moves[r] = own
    assert moves[1] != moves[2] != moves[3]


def test_importance_is_that_of_a_brute_force_shuffle(spark, folded):
    df = MedianImputer(COLS).fit(folded).transform(folded).withColumn("flat", F.lit(1.0))
    model = models.refit(df, models.forest(6, 4), [*COLS, "flat"])
    got = {r["feature"]: r for r in models.permutation_importance(df, model, ["p", "s", "flat"], repeats=3).collect()}
    plain = df.toPandas().set_index("window_id")
    partner = models.partner_rows(df, "window_id", 3).toPandas()

    def f1(pdf):
        out = model.transform(spark.createDataFrame(pdf).withColumn("_label_text", F.col("label")))
        out = out.select(F.col("label").alias("true_label"), F.element_at(F.array(*[F.lit(f"c{i}") for i in range(3)]), F.col("prediction").cast("int") + 1).alias("pred_label"))
        return classification_metrics(out).first()["f1_macro"]

    base = f1(plain.reset_index())
    for c in ("p", "s"):
        drops = []
        for r in (1, 2, 3):
            given_by = partner[partner["repeat"] == r].set_index("window_id")["partner"]
            moved = plain.assign(**{c: plain[c].loc[given_by.loc[plain.index]].to_numpy()})
            drops.append(base - f1(moved.reset_index()))
        assert got[c]["importance_mean"] == pytest.approx(np.mean(drops))
        assert got[c]["importance_std"] == pytest.approx(np.std(drops))
    assert got["p"]["importance_mean"] > 0.1
    assert (got["flat"]["importance_mean"], got["flat"]["importance_std"]) == (0.0, 0.0)
    few = models.permutation_importance(df, model, ["p"], repeats=2, rows=50).collect()
    assert len(few) == 1


PAIRS = st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("abc")), min_size=1, max_size=30)


@settings(max_examples=60, deadline=None)
@given(PAIRS, PAIRS)
def test_no_completion_beats_the_bound(done, later):
    whole = models._macro(Counter(done + later), {})[0]
    assert models._macro(Counter(done), Counter(t for t, _ in later))[0] >= whole - 1e-12


def test_scores_of_counts_are_the_metrics(spark):
    pairs = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "a")] + [("c", "b")] * 3
    want = classification_metrics(spark.createDataFrame(pairs, "true_label string, pred_label string")).first()
    assert models.macro_scores(Counter(pairs)) == pytest.approx((want["f1_macro"], want["accuracy"]))


def test_giving_up_early_keeps_the_best(folded):
    ready = models.prepare_folds(folded, COLS)
    candidates = [(models.forest(4, 3), [c]) for c in COLS] + [(models.forest(4, 3), ["p", "q", "r"])]
    for pooled in (True, False):
        whole = models.evaluate_candidates(ready, candidates, pooled)
        early = models.evaluate_candidates(ready, candidates, pooled, stop_early=True)
        assert max(whole) == whole[-1] == early[-1]
        assert all(e is None or e == w for e, w in zip(early, whole, strict=True))


def test_selection_finds_the_columns_that_tell_classes_apart(folded):
    chosen, steps = models.forward_select(folded, models.forest(5, 4), ["s"], ["p", "q", "r"], 3)
    assert chosen[0] == "s"
    assert len(steps) == len(chosen)
    assert [x["f1_macro"] for x in steps] == sorted(x["f1_macro"] for x in steps)
    assert steps[-1]["f1_macro"] > 0.6


def test_whole_tuning_pipeline(folded):
    over = lambda train: balance.smote(train, COLS).drop("synthetic")
    out, chosen, agreed = models.nested_cv(
        folded, models.forest(4, 3), COLS, {"maxDepth": [1, 5], "bootstrap": [True, False]}, 2, 2, keep=["window_id"],
        stratify=True, normalize=True, resample=over,
    )
    assert out.count() == 240
    assert len(chosen) == 3
    assert agreed in [c["setting"] for c in chosen]
    assert classification_metrics(out).first()["f1_macro"] > 0.75
    scores, tried = models.random_search(folded, models.forest(4, 3), COLS, {"maxDepth": [1, 5]}, 2)
    best = scores.first()
    assert tried[best["setting"]] == {"maxDepth": 5}


def test_concurrent_calls_answer_in_order_and_raise(spark):
    assert concurrently(spark, [lambda i=i: spark.range(i).count() for i in range(20)], 4) == list(range(20))

    def bad():
        raise KeyError("no")

    with pytest.raises(KeyError):
        concurrently(spark, [bad, lambda: 1])


def test_outer_folds_are_searched_side_by_side(folded, monkeypatch):
    met = threading.Barrier(3)  # one outer fold after the other would wait here in vain
    plain = models.group_kfold
    monkeypatch.setattr(models, "group_kfold", lambda *args, **options: (met.wait(60), plain(*args, **options))[1])
    out, chosen, _ = models.nested_cv(folded, models.forest(3, 2), COLS, {"maxDepth": [1, 3]}, 2, 2, keep=["window_id"])
    assert out.count() == 240
    assert [c["fold"] for c in chosen] == [1, 2, 3]


def test_fits_read_files_of_bounded_size(folded, monkeypatch):
    monkeypatch.setattr(models, "FILE_VALUES", 4 * 30)
    for options in ({}, {"normalize": True}):
        ready = models.prepare_folds(folded, COLS, keep=["window_id"], **options)
        for train, _ in ready.parts.values():
            n = train.count()
            assert len(train.inputFiles()) >= n / 30
            assert train.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 30

"""Metrics against published confusion matrices and hand-made cases."""

import pytest
from pyspark.sql import functions as F

from physio_spark.operators import evaluate as E
from physio_spark.operators import splits

CLASSES = ["amused", "bored", "relaxed", "scary"]
# Published confusion matrices of five folds (rows are true classes).
FOLDS = [
    [[148, 69, 42, 171], [54, 99, 122, 59], [59, 110, 98, 84], [115, 49, 45, 200]],
    [[125, 94, 43, 168], [73, 109, 62, 89], [91, 125, 49, 85], [53, 55, 30, 273]],
    [[202, 25, 81, 122], [91, 118, 87, 39], [90, 60, 115, 87], [112, 22, 74, 199]],
    [[149, 98, 20, 91], [54, 114, 53, 57], [86, 137, 36, 33], [107, 41, 24, 170]],
    [[125, 56, 95, 82], [29, 92, 128, 29], [19, 83, 118, 73], [113, 28, 37, 163]],
]


def cells(spark, classes, matrices):
    rows = [
        (f + 1, classes[i], classes[j], n)
        for f, m in enumerate(matrices) for i, line in enumerate(m) for j, n in enumerate(line) if n
    ]
    return spark.createDataFrame(rows, "fold int, true string, pred string, n long")


def test_pooled_report_matches_the_published_one(spark):
    table = cells(spark, CLASSES, FOLDS).groupBy("true", "pred").agg(F.sum("n").alias("n"))
    got = {r["label"]: r for r in E.classification_report(table, counted=True, digits=3).collect()}
    want = {
        "amused": (0.395, 0.373, 0.384, 2006), "bored": (0.336, 0.341, 0.339, 1558), "relaxed": (0.306, 0.254, 0.278, 1638),
        "scary": (0.442, 0.526, 0.480, 1910), "macro avg": (0.370, 0.374, 0.370, 7112), "weighted avg": (0.374, 0.380, 0.375, 7112),
    }
    for label, (p, r, f, n) in want.items():
        row = got[label]
        assert (row["precision"], row["recall"], row["f1"], row["support"]) == (p, r, f, n), label
    assert got["accuracy"]["f1"] == 0.380
    m = E.classification_metrics(table, counted=True).first()
    assert [round(m[c], 4) for c in ("accuracy", "balanced_accuracy", "f1_macro")] == [0.3799, 0.3737, 0.3702]


def test_never_predicted_class_scores_zero(spark):
    table = cells(spark, ["bored", "scary"], [[[0, 9], [0, 11]]]).drop("fold")
    got = {r["label"]: r for r in E.classification_report(table, counted=True, digits=3).collect()}
    assert (got["bored"]["precision"], got["bored"]["recall"], got["bored"]["f1"], got["bored"]["support"]) == (0, 0, 0, 9)
    assert (got["scary"]["precision"], got["scary"]["recall"], got["scary"]["f1"]) == (0.55, 1.0, 0.71)
    assert (got["macro avg"]["precision"], got["macro avg"]["f1"]) == (0.275, 0.355)
    assert (got["weighted avg"]["precision"], got["weighted avg"]["f1"]) == (0.302, 0.39) or got["weighted avg"]["precision"] == 0.303


def test_best_fold_is_the_first_on_a_tie(spark):
    rows = [(f, "a", "a") for f in (1, 2)] + [(f, "b", "b") for f in (1, 2)] + [(3, "a", "b"), (3, "b", "b")]
    df = spark.createDataFrame(rows, "fold int, true_label string, pred_label string")
    assert {r["fold"] for r in E.fold_metrics(df).where("is_best").collect()} == {1}
    single = E.fold_summary_metrics(df.where("fold = 3")).collect()
    assert all(r["std"] == 0 for r in single)


def test_zero_probabilities_give_the_uniform_vote(spark):
    df = spark.createDataFrame([(1, 1, "b", 0.0, 0.0), (1, 2, "a", 0.2, 0.8), (1, 2, "a", 0.7, 0.3)],
                               "subject int, video int, true_label string, proba_a double, proba_b double")
    got = {r["video"]: r for r in E.vote_probability(df, ["a", "b"]).collect()}
    assert got[1]["pred_label"] == "a" and got[1]["prob_accum_normalized"] == {"a": 0.5, "b": 0.5}
    assert got[2]["pred_label"] == "b" and got[2]["prob_accum_normalized"]["b"] == pytest.approx(0.55)


def test_folds_partition_the_groups_and_are_balanced(spark):
    sizes = [40, 11, 10, 9, 8, 3, 1]
    df = spark.createDataFrame([(g,) for g, n in enumerate(sizes) for _ in range(n)], "subject int")
    for method in ("greedy", "snake"):
        table = splits.fold_table(df, "subject", 3, method=method).collect()
        assert sorted(r["subject"] for r in table) == list(range(7))
        assert {r["fold"] for r in table} == {1, 2, 3}
    loads = {r["fold"]: r["count"] for r in splits.group_kfold(df, "subject", 3).groupBy("fold").count().collect()}
    assert sorted(loads.values()) == [20, 22, 40]


def test_stratified_folds_keep_groups_whole(spark):
    rows = [(g, "ab"[(g + i) % 2 if g % 3 else 0]) for g in range(24) for i in range(6)]
    df = spark.createDataFrame(rows, "subject int, label string")
    got = splits.group_kfold(df, "subject", 4, stratify="label")
    assert got.select("subject", "fold").distinct().count() == 24
    shares = got.groupBy("fold").agg(F.avg((F.col("label") == "a").cast("int")).alias("s")).toPandas()["s"]
    assert shares.max() - shares.min() < 0.2

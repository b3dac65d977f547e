"""Evaluation of predictions; every metric is derived from the (small) table of label pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from physio_spark.functions.columns import finite
from physio_spark.operators.ordered import scan
from physio_spark.operators.quantiles import mode_of


def pair_counts(df: DataFrame, by: Sequence[str] = (), true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """Rows per (true, predicted) pair; columns ``true``, ``pred``, ``n``.

    A row without a true or predicted label is an error: left out, it would raise every score.
    """
    held = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"a row has no {c}")).cast(df.schema[c].dataType))
    return df.groupBy(*by, held(true).alias("true"), held(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(
    df: DataFrame,
    by: Sequence[str] = (),
    labels: Sequence | None = None,
    true: str = "true_label",
    pred: str = "pred_label",
    counted: bool = False,
) -> DataFrame:
    """Counts over the union of true and predicted labels, zero-filled, one row per cell.

    ``labels`` fixes the label set instead.  ``counted`` says that ``df`` is already a table of
    (true, pred, n).
    """
    by = list(by)
    cells = df if counted else pair_counts(df, by, true, pred)
    if labels is not None:
        spark = df.sparkSession
        kind = cells.schema["true"].dataType.simpleString()
        values = F.array(*[F.lit(x) for x in labels]).cast(f"array<{kind}>")
        groups = cells.select(*by).distinct() if by else spark.range(1).select()
        frame = groups.withColumn("true", F.explode(values)).withColumn("pred", F.explode(values))
    else:
        # One row per group with its label list; the number of labels is small.
        names = F.array_distinct(F.concat(F.collect_set("true"), F.collect_set("pred")))
        frame = (
            cells.groupBy(*by).agg(names.alias("_labels"))
            .withColumn("true", F.explode("_labels"))
            .withColumn("pred", F.explode("_labels"))
            .drop("_labels")
        )
    return (
        frame.join(cells, [*by, "true", "pred"], "left")
        .select(*by, "true", "pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    )


def per_class(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every label of a confusion matrix; 0 on a zero division."""
    by = list(by)
    n = F.col("n")
    hit = F.sum(F.when(F.col("_is_true") & (F.col("_other") == F.col("label")), n).otherwise(0))
    support = F.sum(F.when(F.col("_is_true"), n).otherwise(0))
    predicted = F.sum(F.when(~F.col("_is_true"), n).otherwise(0))
    sides = matrix.withColumn(
        "_s",
        F.explode(
            F.array(
                F.struct(F.col("true").alias("label"), F.col("pred").alias("other"), F.lit(True).alias("is_true")),
                F.struct(F.col("pred").alias("label"), F.col("true").alias("other"), F.lit(False).alias("is_true")),
            )
        ),
    ).select(*by, "n", F.col("_s.label").alias("label"), F.col("_s.other").alias("_other"), F.col("_s.is_true").alias("_is_true"))
    table = sides.groupBy(*by, "label").agg(hit.alias("_hit"), support.alias("support"), predicted.alias("_predicted"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    table = table.withColumn("precision", ratio("_hit", "_predicted")).withColumn("recall", ratio("_hit", "support"))
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return table.withColumn("f1", f1).withColumnRenamed("_hit", "hits").drop("_predicted")


def classification_metrics(
    df: DataFrame,
    by: Sequence[str] = (),
    true: str = "true_label",
    pred: str = "pred_label",
    counted: bool = False,
) -> DataFrame:
    """Accuracy, balanced accuracy (mean recall of the classes with support), macro F1 and row count."""
    table = per_class(confusion_matrix(df, by, None, true, pred, counted), by)
    n = F.sum("support")
    return table.groupBy(*by).agg(
        (F.sum("hits") / n).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("f1").alias("f1_macro"),
        n.cast("bigint").alias("n"),
    )


def classification_report(
    df: DataFrame,
    by: Sequence[str] = (),
    true: str = "true_label",
    pred: str = "pred_label",
    counted: bool = False,
    digits: int | None = None,
) -> DataFrame:
    """Per-class rows followed by accuracy, macro average and weighted average.

    ``section`` orders the report (0 classes, 1 accuracy, 2 macro, 3 weighted).
    """
    by = list(by)
    table = per_class(confusion_matrix(df, by, None, true, pred, counted), by)
    metrics = ("precision", "recall", "f1")
    classes = table.select(*by, F.lit(0).alias("section"), F.col("label").cast("string"), *metrics, "support")
    n = F.sum("support")
    accuracy = F.sum("hits") / n
    summary = table.groupBy(*by).agg(
        n.alias("support"),
        F.array(
            F.struct(F.lit(1).alias("section"), F.lit("accuracy").alias("label"), *[accuracy.alias(m) for m in metrics]),
            F.struct(F.lit(2).alias("section"), F.lit("macro avg").alias("label"), *[F.avg(m).alias(m) for m in metrics]),
            F.struct(
                F.lit(3).alias("section"),
                F.lit("weighted avg").alias("label"),
                *[(F.sum(F.col(m) * F.col("support")) / n).alias(m) for m in metrics],
            ),
        ).alias("_rows"),
    )
    tail = summary.select(*by, F.explode("_rows").alias("_r"), "support").select(*by, "_r.*", "support")
    out = classes.unionByName(tail)
    if digits is not None:
        out = out.withColumns({m: F.round(m, digits) for m in metrics})
    return out


def fold_metrics(df: DataFrame, fold: str = "fold", true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """Metrics of every fold with ``is_best``: the largest macro F1, the first fold on a tie."""
    table = classification_metrics(df, [fold], true, pred)
    best = table.agg(F.max_by(F.col(fold), F.struct(F.col("f1_macro"), -F.col(fold))).alias("_best"))
    return table.join(F.broadcast(best)).withColumn("is_best", F.col(fold) == F.col("_best")).drop("_best")


def fold_summary_metrics(
    df: DataFrame, fold: str = "fold", true: str = "true_label", pred: str = "pred_label"
) -> DataFrame:
    """Per metric: mean and std (ddof 1, 0 for a single fold) over the folds and the pooled value."""
    names = ["accuracy", "balanced_accuracy", "f1_macro"]
    folds = classification_metrics(df, [fold], true, pred).unpivot([fold], names, "metric", "value")
    pooled = classification_metrics(df, [], true, pred).unpivot([], names, "metric", "pooled")
    spread = folds.groupBy("metric").agg(
        F.avg("value").alias("mean"),
        F.when(F.count("value") < 2, F.lit(0.0)).otherwise(F.stddev_samp("value")).alias("std"),
    )
    return spread.join(pooled, "metric")


# ---------------------------------------------------------------- stimulus level


def vote_majority(
    df: DataFrame, by: Sequence[str] = ("subject", "video"), true: str = "true_label", pred: str = "pred_label"
) -> DataFrame:
    """Most frequent true and predicted label per stimulus, alphabetical on a tie."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_windows"))
    return (
        mode_of(df, by, true, "true_label")
        .join(mode_of(df, by, pred, "pred_label"), list(by))
        .join(sizes, list(by))
    )


def vote_probability(
    df: DataFrame,
    classes: Sequence[str],
    by: Sequence[str] = ("subject", "video"),
    true: str = "true_label",
    prefix: str = "proba_",
) -> DataFrame:
    """Sum the class probabilities of a stimulus, normalise them and take the largest (first on a tie).

    A total of 0 gives the uniform distribution.
    """
    by = list(by)
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.array(*[F.coalesce(F.sum(finite(f"{prefix}{c}")), F.lit(0.0)) for c in classes]).alias("_s"),
    )
    total = F.aggregate("_s", F.lit(0.0), lambda a, x: a + x)
    share = F.when(total > 0, F.transform("_s", lambda x: x / total)).otherwise(
        F.array_repeat(F.lit(1.0 / len(classes)), len(classes))
    )
    names = F.array(*[F.lit(c) for c in classes])
    winner = F.element_at(names, F.array_position("_p", F.array_max("_p")).cast("int"))
    voted = (
        sums.withColumn("_p", share)
        .withColumn("pred_label", winner)
        .withColumn("prob_accum_normalized", F.map_from_arrays(names, F.col("_p")))
        .drop("_s", "_p")
    )
    return mode_of(df, by, true, "true_label").join(voted, by)


def running_vote(
    df: DataFrame,
    by: Sequence[str] = ("subject", "video"),
    order: Sequence[str] = ("end_us",),
    pred: str = "pred_label",
    target: Column | str | None = None,
    *,
    width: int,
) -> DataFrame:
    """Share of windows so far that were predicted as ``target`` (default: the true label)."""
    goal = F.col("true_label") if target is None else (F.lit(target) if isinstance(target, str) else target)
    hit = (F.col(pred) == goal).cast("bigint")
    rows = scan(df, by, list(order), width, running={"votes": F.coalesce(hit, F.lit(0))}, index="_i")
    return rows.withColumn("n_seen", F.col("_i") + 1).withColumn("share", F.col("votes") / F.col("n_seen")).drop("_i")


__all__ = [
    "classification_metrics", "classification_report", "confusion_matrix", "fold_metrics", "fold_summary_metrics",
    "pair_counts", "per_class", "running_vote", "vote_majority", "vote_probability",
]

"""Queries: cleaning, balancing, folds, models, evaluation and streams over feature tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from physio_spark.operators import balance, clean, models, splits
from physio_spark.operators import evaluate as E
from physio_spark.plans.adapter import (
    SQL_PREDICTIONS,
    SQL_SAMPLES,
    orders_as_predictions,
    samples,
    table,
)
from physio_spark.plans.registry import final, query
from physio_spark.runtime import materialize
from physio_spark.streaming import jobs
from physio_spark.streaming.replay import replay

NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
SQL_DIRTY = """
d AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_tax > 0.07 THEN 'NaN'::DOUBLE
             WHEN l_discount > 0.09 THEN 'Infinity'::DOUBLE ELSE l_quantity END AS v, CAST(NULL AS DOUBLE) AS void, 3.0::DOUBLE AS flat FROM lineitem)
"""


def _dirty(spark, sf_dir):
    dirty = (
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("double"))
        .when(F.col("l_tax") > 0.07, F.lit(math.nan))
        .when(F.col("l_discount") > 0.09, F.lit(math.inf))
        .otherwise(F.col("l_quantity"))
    )
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", dirty.alias("v"), F.lit(None).cast("double").alias("void"), F.lit(3.0).alias("flat")
    )


@query(
    "cln1_clean",
    final(
        SQL_DIRTY,
        "SELECT l_orderkey, l_linenumber, CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 0.0 ELSE v END AS v FROM d",
        ["v"],
        ["l_linenumber"],
    ),
)
def cln1(spark, sf_dir):
    return clean.clean(_dirty(spark, sf_dir), ["v"]).select("l_orderkey", "l_linenumber", "v")


@query(
    "cln2_drop_empty",
    final(SQL_DIRTY, "SELECT l_orderkey, CASE WHEN isfinite(v) THEN v END AS v, flat FROM d", ["v", "flat"]),
)
def cln2(spark, sf_dir):
    d = clean.clean(_dirty(spark, sf_dir).drop("l_linenumber"), ["v"], fill=None)
    return clean.drop_empty(d, ["v", "void", "flat"])


@query(
    "cln3_drop_constant",
    final(SQL_DIRTY, "SELECT l_orderkey, CASE WHEN isfinite(v) THEN v END AS v FROM d", ["v"]),
)
def cln3(spark, sf_dir):
    d = clean.clean(_dirty(spark, sf_dir).drop("l_linenumber"), ["v"], fill=None)
    return clean.drop_constant(d, ["v", "void", "flat"])


@query(
    "cln4_median_impute",
    final(
        SQL_DIRTY + ", t AS (SELECT median(v) AS m FROM d WHERE isfinite(v) AND l_orderkey % 5 <> 0)",
        "SELECT l_orderkey, l_linenumber, CASE WHEN isfinite(v) THEN v ELSE m END AS v FROM d, t WHERE l_orderkey % 5 = 0",
        ["v"],
        ["l_linenumber"],
    ),
)
def cln4(spark, sf_dir):
    d = _dirty(spark, sf_dir).select("l_orderkey", "l_linenumber", "v")
    imputer = clean.MedianImputer(["v"]).fit(d.where("l_orderkey % 5 <> 0"))
    return imputer.transform(d.where("l_orderkey % 5 = 0"))


@query(
    "cln5_standard_scale",
    final(
        "t AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, avg(l_extendedprice) AS m2, stddev_pop(l_extendedprice) AS s2 FROM lineitem)",
        "SELECT l_orderkey, (l_quantity - m) / s AS l_quantity, (l_extendedprice - m2) / s2 AS l_extendedprice FROM lineitem, t",
        ["l_quantity", "l_extendedprice"],
    ),
)
def cln5(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    scaler = clean.StandardScaler(["l_quantity", "l_extendedprice"])
    return scaler.fit(li).transform(li)


@query("cln6_quantile_normal")
def cln6(spark, sf_dir):
    """No inverse normal distribution in the SQL engine; the tests compare with the standard library."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    return clean.QuantileNormalizer(["l_quantity", "l_extendedprice"]).fit(li).transform(li)


def _downsample_sql(goal: str) -> str:
    return final(
        f"""c AS (SELECT l_linestatus || l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY 1),
            u AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_linestatus || l_returnflag AS label FROM lineitem),
            k AS (SELECT DISTINCT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'O' ELSE o_orderpriority END AS label FROM orders),
            kc AS (SELECT label, count(*) AS n FROM k GROUP BY label),
            g AS (SELECT CAST(floor({goal}) AS BIGINT) AS goal FROM kc WHERE label <> 'O'),
            r AS (SELECT k.*, row_number() OVER (PARTITION BY label = 'O' ORDER BY md5('42|' || o_orderkey), o_orderkey) AS rn FROM k)""",
        "SELECT o_orderkey, label FROM r, g WHERE label <> 'O' OR rn <= goal",
    )


def _unbalanced(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    label = F.when(F.col("o_orderstatus") == "O", "O").otherwise(F.col("o_orderpriority"))
    return o.select("o_orderkey", label.alias("label"))


@query("cln7_downsample_median", _downsample_sql("median(n)"))
def cln7(spark, sf_dir):
    return clean.downsample_class(_unbalanced(spark, sf_dir), "O", "median", key=["o_orderkey"])


@query("cln7_downsample_min", _downsample_sql("min(n)"))
def cln7_min(spark, sf_dir):
    return clean.downsample_class(_unbalanced(spark, sf_dir), "O", "min", key=["o_orderkey"])


@query(
    "cln8_sample_groups",
    final(
        SQL_SAMPLES
        + """g AS (SELECT DISTINCT video, subject FROM s),
             r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY md5('7|' || video || '|' || subject), subject) AS rn FROM g)""",
        "SELECT s.event_id, s.video, s.subject FROM s JOIN r ON r.video = s.video AND r.subject = s.subject WHERE rn <= 20",
        longs=["video"],
    ),
)
def cln8(spark, sf_dir):
    s = samples(spark, sf_dir).select("event_id", "video", "subject")
    return clean.sample_groups(s, 20, 7)


VEC = [f"f{i}" for i in range(64)]


def vectors(spark, sf_dir, n: int = 64, uneven: bool = False):
    """The embeddings as a window table: id, subject, label and one column per feature."""
    e = table(spark, sf_dir, "embeddings")
    label = F.concat(F.lit("c"), F.when(F.col("label") < 5, F.lit(0)).otherwise(F.col("label")) if uneven else F.col("label"))
    return e.select(
        F.col("vec_id").alias("window_id"),
        F.pmod("vec_id", F.lit(50)).alias("subject"),
        label.alias("label"),
        *[F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(n)],
    )


@query("cln9_smote")
def cln9(spark, sf_dir):
    v = vectors(spark, sf_dir, uneven=True)
    return balance.smote(v, VEC).groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@query("cln9_smote_borderline")
def cln9_borderline(spark, sf_dir):
    v = vectors(spark, sf_dir, uneven=True)
    out = balance.smote(v, VEC, variant="borderline")
    return out.groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@query(
    "cln9_nearest_neighbours",
    final(
        """q AS (SELECT a.vec_id AS window_id, b.vec_id AS neighbour, list_sum(list_transform(list_zip(a.embedding, b.embedding),
                  lambda p: power(p[1]::DOUBLE - p[2]::DOUBLE, 2))) AS dist2 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)""",
        "SELECT window_id, neighbour, dist2, row_number() OVER (PARTITION BY window_id ORDER BY dist2, neighbour) AS rank FROM q QUALIFY rank <= 3",
        ["dist2"],
    ),
)
def cln9_neighbours(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("window_id"), F.col("embedding").cast("array<double>").alias("v")
    )
    return balance.nearest_neighbours(e, e, "window_id", "v", 3, tile=200)


def _weights_sql(weight: str) -> str:
    return final(
        "c AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT sum(n) AS total, count(*) AS k, avg(1.0 / (n + 1e-8)) AS m FROM c)",
        f"SELECT l_orderkey, l_returnflag, {weight} AS weight FROM lineitem JOIN c USING (l_returnflag), t",
        ["weight"],
    )


@query("cln10_balanced_weights", _weights_sql("total / (k * n)::DOUBLE"))
def cln10(spark, sf_dir):
    return clean.class_weights(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag"), "l_returnflag")


@query("cln10_inverse_weights", _weights_sql("1.0 / (n + 1e-8) / m"))
def cln10_inverse(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    return clean.class_weights(li, "l_returnflag", "inverse")


# ---------------------------------------------------------------- folds and models

SQL_FOLDS = """
g AS (SELECT l_suppkey AS subject, count(*) AS n FROM lineitem GROUP BY 1),
o AS (SELECT subject, n, row_number() OVER (ORDER BY n DESC, subject) AS rn FROM g),
walk AS (SELECT 0::BIGINT AS rn, NULL::BIGINT AS subject, 0::BIGINT AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS loads
         UNION ALL
         SELECT o.rn, o.subject, list_position(loads, list_min(loads))::BIGINT,
                list_transform(loads, lambda v, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN v + o.n ELSE v END)
         FROM walk JOIN o ON o.rn = walk.rn + 1),
f AS (SELECT subject, fold FROM walk WHERE rn > 0),
"""


def recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


@query("ml1_group_kfold", recursive(final(SQL_FOLDS, "SELECT subject, fold FROM f")))
def ml1(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject"))
    return splits.fold_table(li, "subject", 5)


@query(
    "ml1_group_kfold_snake",
    final(
        """g AS (SELECT l_suppkey AS subject, count(*) AS n FROM lineitem GROUP BY 1),
           o AS (SELECT subject, row_number() OVER (ORDER BY n DESC, md5('0|' || subject), subject) - 1 AS p FROM g)""",
        "SELECT subject, CASE WHEN (p // 5) % 2 = 0 THEN p % 5 ELSE 4 - p % 5 END + 1 AS fold FROM o",
        longs=["fold"],
    ),
)
def ml1_snake(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject"))
    return splits.fold_table(li, "subject", 5, method="snake")


@query("ml2_stratified_group_kfold")
def ml2(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject"), F.col("l_returnflag").alias("label"))
    folds = splits.group_kfold(li, "subject", 5, stratify="label")
    return folds.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ml3_fold_summary",
    recursive(
        final(
            SQL_FOLDS
            + """w AS (SELECT l_suppkey AS subject, l_returnflag AS label, fold FROM lineitem JOIN f ON f.subject = l_suppkey),
                 k AS (SELECT DISTINCT fold AS kf FROM f)""",
            "SELECT kf AS fold, count(*) FILTER (WHERE fold <> kf) AS n_train_samples, count(*) FILTER (WHERE fold = kf) AS n_val_samples, "
            "count(DISTINCT label) FILTER (WHERE fold <> kf) AS train_classes, count(DISTINCT label) FILTER (WHERE fold = kf) AS val_classes, "
            "array_to_string(list_sort(list_distinct(list(subject) FILTER (WHERE fold <> kf))), ',') AS train_subjects, "
            "array_to_string(list_sort(list_distinct(list(subject) FILTER (WHERE fold = kf))), ',') AS val_subjects, "
            "count(DISTINCT label) FILTER (WHERE fold <> kf) >= 2 AND count(DISTINCT label) FILTER (WHERE fold <> kf) = "
            "count(DISTINCT label) FILTER (WHERE fold = kf) AS usable FROM w, k GROUP BY kf",
        )
    ),
)
def ml3(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject"), F.col("l_returnflag").alias("label"))
    return splits.fold_summary(splits.group_kfold(li, "subject", 5))


@query(
    "ml3_fold_members",
    recursive(
        final(
            SQL_FOLDS + "own_fold AS (SELECT DISTINCT l_suppkey AS subject, fold AS own FROM lineitem JOIN f ON f.subject = l_suppkey), k AS (SELECT DISTINCT fold AS fold FROM f)",
            "SELECT k.fold, CASE WHEN own = k.fold THEN 'val' ELSE 'train' END AS role, subject FROM own_fold, k",
        )
    ),
)
def ml3_members(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject"))
    return splits.fold_members(splits.group_kfold(li, "subject", 5))


def _folded(spark, sf_dir, n: int = 64, k: int = 5):
    return materialize(splits.group_kfold(vectors(spark, sf_dir, n), "subject", k))


KEEP = ["window_id", "subject"]


@query("ml4_oof_forest")
def ml4(spark, sf_dir):
    d = _folded(spark, sf_dir)
    return models.oof_classify(d, models.forest(20, 6, seed=1), VEC, keep=KEEP)


@query("ml5_oof_neural_net")
def ml5(spark, sf_dir):
    d = _folded(spark, sf_dir)
    return models.oof_classify(d, models.neural_net(64, 10, (16,), maxIter=15), VEC, keep=KEEP, scale=True)


def _with_targets(spark, sf_dir):
    d = _folded(spark, sf_dir)
    return d.withColumn("valence", F.col("f0") + F.col("f1") * 2).withColumn("arousal", F.col("f2") - F.col("f3"))


@query("ml6_oof_regress_linear")
def ml6(spark, sf_dir):
    out = models.oof_regress(_with_targets(spark, sf_dir), ["valence", "arousal"], VEC[4:], "linear")
    return out.select(*KEEP, "fold", "pred_valence", "pred_arousal")


@query("ml6_oof_regress_forest")
def ml6_forest(spark, sf_dir):
    out = models.oof_regress(_with_targets(spark, sf_dir), ["valence"], VEC, "forest", trees=20)
    return out.select(*KEEP, "fold", "pred_valence")


SPACE = {
    "numTrees": [5, 10, 20], "maxDepth": [3, 5, 8], "impurity": ["gini", "entropy"],
    "featureSubsetStrategy": ["sqrt", "log2", "all"], "minInstancesPerNode": [2, 3, 4], "bootstrap": [True, False],
}


@query("ml7_random_search")
def ml7(spark, sf_dir):
    scores, _ = models.random_search(_folded(spark, sf_dir), models.forest(10, 4), VEC, SPACE, 6)
    return scores


@query("ml8_nested_cv")
def ml8(spark, sf_dir):
    d = _folded(spark, sf_dir)
    predictions, _, _ = models.nested_cv(d, models.forest(10, 4), VEC, SPACE, 4, 3, keep=KEEP)
    return predictions


def _oversampled(train):
    return balance.smote(train, VEC, variant="borderline").drop("synthetic")


@query("ml8_tuned_pipeline")
def ml8_tuned(spark, sf_dir):
    """Impute, map to normal quantiles, over-sample the rarer class and search the forest's settings, in each of three folds."""
    d = vectors(spark, sf_dir).withColumn("label", F.when(F.col("label") < "c7", F.lit("often")).otherwise(F.lit("seldom")))
    d = materialize(splits.group_kfold(d, "subject", 3, stratify="label"))
    predictions, _, _ = models.nested_cv(
        d, models.forest(10, 4), VEC, SPACE, 2, 2, keep=KEEP, stratify=True, normalize=True, resample=_oversampled
    )
    return predictions


@query("ml10_importances")
def ml10(spark, sf_dir):
    d = vectors(spark, sf_dir)
    return models.importances(models.refit(d, models.forest(20, 6), VEC), VEC, spark)


@query("ml11_permutation_importance")
def ml11(spark, sf_dir):
    d = vectors(spark, sf_dir)
    return models.permutation_importance(d, models.refit(d, models.forest(20, 6), VEC), VEC)


@query("ml12_feature_elimination")
def ml12(spark, sf_dir):
    d = vectors(spark, sf_dir)
    kept = models.rfe(d, models.forest(20, 6), VEC, 32)
    return d.select("window_id", *kept)


@query("ml13_forward_selection")
def ml13(spark, sf_dir):
    d = _folded(spark, sf_dir)
    chosen, _ = models.forward_select(d, models.forest(4, 3), ["f0"], VEC[1:], 2)
    return d.select("window_id", *chosen)


@query("ml14_held_out_score")
def ml14(spark, sf_dir):
    d = vectors(spark, sf_dir)
    held = [0, 7, 21, 33]
    model = models.refit(d.where(~F.col("subject").isin(held)), models.forest(20, 6), VEC)
    return models.score(d, model, held, keep=KEEP)


# ---------------------------------------------------------------- evaluation


def sql_metrics(tag: str, fold: str) -> str:
    """Confusion cells, per-class numbers and metrics per fold; ``tag`` keeps the names apart."""
    return f"""
p{tag} AS (SELECT true_label, pred_label, {fold} AS fold FROM p),
u{tag} AS (SELECT fold, true_label AS label FROM p{tag} UNION SELECT fold, pred_label FROM p{tag}),
cell{tag} AS (SELECT a.fold, a.label AS "true", b.label AS pred, (SELECT count(*) FROM p{tag} q WHERE q.fold = a.fold
              AND q.true_label = a.label AND q.pred_label = b.label) AS n FROM u{tag} a JOIN u{tag} b ON a.fold = b.fold),
pc{tag} AS (SELECT fold, label, (SELECT sum(n) FROM cell{tag} c WHERE c.fold = u.fold AND c."true" = u.label AND c.pred = u.label) AS hits,
            (SELECT sum(n) FROM cell{tag} c WHERE c.fold = u.fold AND c."true" = u.label) AS support,
            (SELECT sum(n) FROM cell{tag} c WHERE c.fold = u.fold AND c.pred = u.label) AS predicted FROM u{tag} u),
pr{tag} AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted::DOUBLE ELSE 0.0 END AS "precision",
            CASE WHEN support > 0 THEN hits / support::DOUBLE ELSE 0.0 END AS recall FROM pc{tag}),
f1{tag} AS (SELECT *, CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0.0 END AS f1 FROM pr{tag}),
me{tag} AS (SELECT fold, sum(hits) / sum(support)::DOUBLE AS accuracy, avg(recall) FILTER (WHERE support > 0) AS balanced_accuracy,
            avg(f1) AS f1_macro, sum(support) AS n FROM f1{tag} GROUP BY fold),
"""


SQL_CELLS = SQL_PREDICTIONS + sql_metrics("_f", "fold")
SQL_POOLED = SQL_PREDICTIONS + sql_metrics("_p", "0")
MACROS = ["accuracy", "balanced_accuracy", "f1_macro"]


@query("evl1_confusion_by_fold", final(SQL_CELLS, 'SELECT fold, "true", pred, n FROM cell_f'))
def evl1(spark, sf_dir):
    return E.confusion_matrix(orders_as_predictions(spark, sf_dir), ["fold"])


@query("evl1_confusion_pooled", final(SQL_POOLED, 'SELECT "true", pred, n FROM cell_p'))
def evl1_pooled(spark, sf_dir):
    return E.confusion_matrix(orders_as_predictions(spark, sf_dir))


@query(
    "evl1_confusion_fixed_labels",
    final(
        SQL_PREDICTIONS + "l(label) AS (VALUES ('1-URGENT'), ('5-LOW'), ('9-NEVER'))",
        'SELECT a.label AS "true", b.label AS pred, (SELECT count(*) FROM p WHERE true_label = a.label AND pred_label = b.label) AS n FROM l a, l b',
    ),
)
def evl1_fixed(spark, sf_dir):
    return E.confusion_matrix(orders_as_predictions(spark, sf_dir), labels=["1-URGENT", "5-LOW", "9-NEVER"])


@query("evl2_evl3_metrics_by_fold", final(SQL_CELLS, "SELECT * FROM me_f", MACROS, ["n"]))
def evl2(spark, sf_dir):
    return E.classification_metrics(orders_as_predictions(spark, sf_dir), ["fold"])


@query("evl3_metrics_pooled", final(SQL_POOLED, "SELECT accuracy, balanced_accuracy, f1_macro, n FROM me_p", MACROS, ["n"]))
def evl3(spark, sf_dir):
    return E.classification_metrics(orders_as_predictions(spark, sf_dir))


@query(
    "evl4_classification_report",
    final(
        SQL_POOLED,
        'SELECT 0 AS section, label, "precision", recall, f1, support FROM f1_p UNION ALL '
        "SELECT 1, 'accuracy', accuracy, accuracy, accuracy, n FROM me_p UNION ALL "
        "SELECT 2, 'macro avg', avg(\"precision\"), avg(recall), avg(f1), sum(support) FROM f1_p UNION ALL "
        "SELECT 3, 'weighted avg', sum(\"precision\" * support) / sum(support), sum(recall * support) / sum(support), "
        "sum(f1 * support) / sum(support), sum(support) FROM f1_p",
        ['"precision"', "recall", "f1"],
        ["section", "support"],
    ),
)
def evl4(spark, sf_dir):
    return E.classification_report(orders_as_predictions(spark, sf_dir))


@query(
    "evl5_fold_summary",
    final(
        SQL_CELLS + sql_metrics("_p", "0")
        + """fm AS (SELECT 'accuracy' AS metric, accuracy AS value FROM me_f UNION ALL SELECT 'balanced_accuracy', balanced_accuracy FROM me_f
             UNION ALL SELECT 'f1_macro', f1_macro FROM me_f),
             pm AS (SELECT 'accuracy' AS metric, accuracy AS pooled FROM me_p UNION ALL SELECT 'balanced_accuracy', balanced_accuracy FROM me_p
             UNION ALL SELECT 'f1_macro', f1_macro FROM me_p)""",
        "SELECT metric, avg(value) AS mean, stddev_samp(value) AS std, any_value(pooled) AS pooled FROM fm JOIN pm USING (metric) GROUP BY metric",
        ["mean", "std", "pooled"],
    ),
)
def evl5(spark, sf_dir):
    return E.fold_summary_metrics(orders_as_predictions(spark, sf_dir))


@query(
    "ml15_best_fold",
    final(
        SQL_CELLS,
        "SELECT *, row_number() OVER (ORDER BY f1_macro DESC, fold) = 1 AS is_best FROM me_f",
        MACROS,
        ["n"],
    ),
)
def ml15(spark, sf_dir):
    return E.fold_metrics(orders_as_predictions(spark, sf_dir))


@query(
    "evl6_vote_majority",
    final(
        SQL_PREDICTIONS
        + """t AS (SELECT subject, video, true_label FROM p GROUP BY subject, video, true_label
                   QUALIFY row_number() OVER (PARTITION BY subject, video ORDER BY count(*) DESC, true_label) = 1),
             q AS (SELECT subject, video, pred_label FROM p GROUP BY subject, video, pred_label
                   QUALIFY row_number() OVER (PARTITION BY subject, video ORDER BY count(*) DESC, pred_label) = 1),
             n AS (SELECT subject, video, count(*) AS n_windows FROM p GROUP BY ALL)""",
        "SELECT subject, video, true_label, pred_label, n_windows FROM t JOIN q USING (subject, video) JOIN n USING (subject, video)",
    ),
)
def evl6(spark, sf_dir):
    return E.vote_majority(orders_as_predictions(spark, sf_dir))


@query(
    "evl7_vote_probability",
    final(
        SQL_PREDICTIONS
        + """t AS (SELECT subject, video, true_label FROM p GROUP BY subject, video, true_label
                   QUALIFY row_number() OVER (PARTITION BY subject, video ORDER BY count(*) DESC, true_label) = 1),
             q AS (SELECT subject, video, count(*) AS n_windows, sum(proba_amused) AS a, sum(proba_bored) AS b, sum(proba_scary) AS c FROM p GROUP BY ALL),
             r AS (SELECT *, CASE WHEN a + b + c > 0 THEN a / (a + b + c) ELSE 1 / 3.0 END AS pa, CASE WHEN a + b + c > 0 THEN b / (a + b + c) ELSE 1 / 3.0 END AS pb,
                   CASE WHEN a + b + c > 0 THEN c / (a + b + c) ELSE 1 / 3.0 END AS pc FROM q)""",
        "SELECT subject, video, true_label, n_windows, CASE WHEN pa >= pb AND pa >= pc THEN 'amused' WHEN pb >= pc THEN 'bored' ELSE 'scary' END AS pred_label, "
        "pa AS p_amused, pb AS p_bored, pc AS p_scary FROM t JOIN r USING (subject, video)",
        ["p_amused", "p_bored", "p_scary"],
    ),
)
def evl7(spark, sf_dir):
    out = E.vote_probability(orders_as_predictions(spark, sf_dir), ["amused", "bored", "scary"])
    probs = F.col("prob_accum_normalized")
    return out.select(
        "subject", "video", "true_label", "n_windows", "pred_label",
        *[probs[c].alias(f"p_{c}") for c in ("amused", "bored", "scary")],
    )


@query(
    "evl8_running_vote",
    final(
        SQL_PREDICTIONS,
        "SELECT position, sum(CASE WHEN pred_label = true_label THEN 1 ELSE 0 END) OVER w AS votes, count(*) OVER w AS n_seen, "
        "sum(CASE WHEN pred_label = true_label THEN 1 ELSE 0 END) OVER w / (count(*) OVER w)::DOUBLE AS share FROM p "
        "WINDOW w AS (PARTITION BY subject, video ORDER BY position)",
        ["share"],
        ["votes"],
    ),
)
def evl8(spark, sf_dir):
    from physio_spark.operators.ordered import chunk_width

    p = orders_as_predictions(spark, sf_dir)
    width = chunk_width(p, ["subject", "video"], "position", 5000)
    return E.running_vote(p, order=["position"], width=width).select("position", "votes", "n_seen", "share")


# ---------------------------------------------------------------- streams: two parts, a restart between them, the sink's rows


@query(
    "str1_sliding_windows",
    final(
        f"""{SQL_SAMPLES.strip().rstrip(',')},
        e AS (SELECT subject, value, t, unnest([t // 86400000000, t // 86400000000 - 1]) AS day FROM s)""",
        "SELECT subject, make_timestamp(day * 86400000000) AS win_start, make_timestamp((day + 2) * 86400000000) AS win_end, count(*) AS n, "
        "avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max FROM e GROUP BY subject, day",
        ["mean", "std", "min", "max"],
    ),
)
def str1(spark, sf_dir):
    live = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject"), F.col("ts").cast("timestamp").alias("ts"), "value"
    )
    out = replay(live, "ts", lambda d: jobs.window_stats_stream(d, "2 days", "1 day", late="1 hour"), "10 days")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("win_start", "win_end")})


@query(
    "str2_sessions",
    final(
        SQL_SAMPLES
        + """g AS (SELECT *, CASE WHEN t - lag(t) OVER w >= 43200000000 THEN 1 ELSE 0 END AS opens FROM s WINDOW w AS (PARTITION BY subject ORDER BY t)),
             n AS (SELECT *, sum(opens) OVER (PARTITION BY subject ORDER BY t) AS session FROM g)""",
        'SELECT subject, make_timestamp(min(t)) AS start, make_timestamp(max(t)) AS "end", count(*) AS n FROM n GROUP BY subject, session',
    ),
)
def str2(spark, sf_dir):
    live = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), F.col("ts").cast("timestamp").alias("ts"))
    out = replay(live, "ts", lambda d: jobs.session_stream(d, "12 hours", ["subject"], late="1 hour"), "10 days")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query(
    "str3_running_vote_state",
    final(
        SQL_PREDICTIONS,
        "SELECT subject, video, sum(CASE WHEN pred_label = true_label THEN 1 ELSE 0 END) AS votes, count(*) AS n_seen, "
        "avg(CASE WHEN pred_label = true_label THEN 1.0 ELSE 0.0 END) AS share FROM p GROUP BY ALL",
        ["share"],
        ["votes"],
    ),
)
def str3(spark, sf_dir):
    """The stateful stream: one row for every stimulus, when its time to live is over."""
    live = orders_as_predictions(spark, sf_dir, F.col("o_orderdate").cast("timestamp").alias("ts"))
    years = 10 * 366 * 86_400.0
    vote = lambda d: jobs.running_vote_stream(d, ts="ts", ttl_s=years, late="1 day", closing=True)
    return replay(live.select("subject", "video", "true_label", "pred_label", "ts"), "ts", vote, "11 years")



"""Out-of-fold prediction, search and selection with Spark ML estimators.

Loops on the driver run over folds, parameters or features only; every fit and every score is a
distributed job, and metrics are computed on the predictions without collecting them.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import partial, reduce
from threading import Lock

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from physio_spark.functions.columns import finite, portable_hash
from physio_spark.operators import forest as regression_forest
from physio_spark.operators.clean import MedianImputer, QuantileNormalizer, StandardScaler
from physio_spark.operators.evaluate import classification_metrics, fold_metrics, pair_counts
from physio_spark.operators.ordered import numbered
from physio_spark.operators.quantiles import quantiles
from physio_spark.operators.splits import group_kfold
from physio_spark.runtime import concurrently, materialize


def forest(trees: int = 800, depth: int = 30, min_leaf: int = 2, seed: int = 42, **params) -> RandomForestClassifier:
    """Random forest with the usual settings."""
    if depth > 30:
        raise ValueError(f"Spark ML's forests have a maxDepth of 30 at most; {depth} was asked for")
    return RandomForestClassifier(
        numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed,
        featureSubsetStrategy=params.pop("featureSubsetStrategy", "sqrt"), **params,
    )


def neural_net(n_features: int, n_classes: int, hidden: Sequence[int] = (64, 32), seed: int = 42, **params):
    """Multilayer perceptron (sigmoid hidden layers, softmax output)."""
    return MultilayerPerceptronClassifier(layers=[n_features, *hidden, n_classes], seed=seed, **params)


def label_order(df: DataFrame, label: str) -> list[str]:
    """Class names in alphabetical order (one row per class)."""
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("l")).distinct()
    return sorted(r["l"] for r in rows.collect())


def classifier_pipeline(estimator: Estimator, features: Sequence[str], classes: Sequence[str], label: str, weight=None):
    index = StringIndexerModel.from_labels(list(classes), inputCol="_label_text", outputCol="_label_index")
    vector = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="error")
    model = estimator.copy().setFeaturesCol("_features").setLabelCol("_label_index")
    if weight and model.hasParam("weightCol"):
        model = model.setWeightCol(weight)
    return Pipeline(stages=[index, vector, model])


def _with_text(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn("_label_text", F.col(label).cast("string"))


def _readable(scored: DataFrame, classes: Sequence[str], keep: Sequence[str], label: str) -> DataFrame:
    names = F.array(*[F.lit(c) for c in classes])
    proba = vector_to_array("probability")
    return scored.select(
        *keep,
        F.col(label).cast("string").alias("true_label"),
        F.element_at(names, F.col("prediction").cast("int") + 1).alias("pred_label"),
        *[F.get(proba, F.lit(i)).alias(f"proba_{c}") for i, c in enumerate(classes)],
    )


def folds_of(df: DataFrame, fold: str = "fold") -> list:
    return sorted(r[fold] for r in df.select(fold).distinct().collect())


# Values in a file of training rows (8 MB of doubles): a fit reads each file in a task of its own.
FILE_VALUES = 1 << 20


def _file_rows(features: Sequence[str]) -> int:
    return max(1, FILE_VALUES // max(1, len(features)))


@dataclass
class PreparedFolds:
    """Every fold's training and validation rows, prepared once and written to a folder of their own."""

    parts: dict
    classes: list[str]
    label: str
    kept: list[str]
    features: list[str]
    weight: str | None = None

    def fit(self, estimator: Estimator, fold, features: Sequence[str] | None = None) -> PipelineModel:
        train = self.parts[fold][0]
        return classifier_pipeline(estimator, features or self.features, self.classes, self.label, self.weight).fit(train)

    def predict(self, model: PipelineModel, fold) -> DataFrame:
        return _readable(model.transform(self.parts[fold][1]), self.classes, self.kept, self.label)

    def counts(self, estimator: Estimator, fold, features: Sequence[str] | None = None) -> Counter:
        """Validation rows of each pair of true and predicted class."""
        scored = self.predict(self.fit(estimator, fold, features), fold)
        return Counter({(r["true"], r["pred"]): r["n"] for r in pair_counts(scored).collect()})  # classes squared

    def supports(self) -> dict:
        """Validation rows of each class in each fold."""
        held = lambda fold: self.parts[fold][1].groupBy("_label_text").count().collect()
        return {fold: Counter({r["_label_text"]: r["count"] for r in held(fold)}) for fold in self.parts}


def _fold_rows(df: DataFrame, features: Sequence[str], fold: str, impute: bool, scale: bool) -> tuple[DataFrame, list]:
    """Every row once for each fold ``_of``, imputed and scaled by what the fold's training rows (``_train``) say; the folds."""
    df = materialize(df, rows=_file_rows(features))
    folds = folds_of(df, fold)
    both = df.withColumn("_of", F.explode(F.array(*[F.lit(f) for f in folds]))).withColumn("_train", F.col("_of") != F.col(fold))
    if impute:
        medians = quantiles(both.where("_train"), ["_of"], {f"_m_{c}": (c, 0.5) for c in features})
        both = both.join(F.broadcast(medians), "_of")  # a row for each fold
        both = both.withColumns({c: F.coalesce(finite(c), F.col(f"_m_{c}")) for c in features}).drop(*[f"_m_{c}" for c in features])
    if scale:
        moments = [a for c in features for a in (F.avg(finite(c)).alias(f"_a_{c}"), F.stddev_pop(finite(c)).alias(f"_d_{c}"))]
        told = both.where("_train").groupBy("_of").agg(*moments)
        shift = lambda c: F.coalesce(F.col(f"_a_{c}"), F.lit(0.0))
        spread = lambda c: F.coalesce(F.nullif(F.col(f"_d_{c}"), F.lit(0.0)), F.lit(1.0))
        both = both.join(F.broadcast(told), "_of").withColumns({c: (finite(c) - shift(c)) / spread(c) for c in features})
        both = both.drop(*[f"_{k}_{c}" for k in "ad" for c in features])
    return both, folds


def prepare_folds(
    df: DataFrame,
    features: Sequence[str],
    label: str = "label",
    fold: str = "fold",
    keep: Sequence[str] = (),
    scale: bool = False,
    impute: bool = True,
    normalize: bool = False,
    weight: str | None = None,
    resample: Callable[[DataFrame], DataFrame] | None = None,
) -> PreparedFolds:
    """Impute, map to normal quantiles, scale and ``resample`` every fold by what its training rows say.

    Medians and moments of all folds come from one pass each, in which a row stands in the training part of
    every other fold.  The rows are written once, a folder for each fold and part, in files of bounded size;
    many fits read them.
    """
    spark, size = df.sparkSession, _file_rows(features)
    classes = label_order(df, label)
    kept = [c for c in dict.fromkeys([*keep, fold]) if c not in (label, *features)]
    text = _with_text(df, label).select(*kept, label, "_label_text", *features, *([weight] if weight else []))
    both, folds = _fold_rows(text, features, fold, impute, scale and not normalize)
    both = materialize(both, ["_of", "_train"], size)

    def part(f) -> tuple:
        train, val = (both.where((F.col("_of") == F.lit(f)) & (F.col("_train") == F.lit(t))).drop("_of", "_train") for t in (True, False))
        if normalize:
            for step in [QuantileNormalizer(features), *([StandardScaler(features)] if scale else [])]:
                step.fit(train)
                train, val = step.transform(train), step.transform(val)
            train, val = materialize(train, rows=size), materialize(val, rows=size)
        if resample is not None:
            # new rows are made from the columns they are given: the text of their label follows
            train = materialize(_with_text(resample(train), label), rows=size)
        return f, (train, val)

    parts = dict(concurrently(spark, [partial(part, f) for f in folds]))
    return PreparedFolds(parts, classes, label, kept, list(features), weight)


def oof_classify(
    df: DataFrame,
    estimator: Estimator,
    features: Sequence[str],
    label: str = "label",
    fold: str = "fold",
    keep: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Predict every fold with a model trained on the others; the folds are fitted side by side.

    ``options`` go to :func:`prepare_folds`: imputing, scaling, mapping to normal quantiles and ``resample``
    (for instance over-sampling) see the training rows only.
    Output: ``keep``, fold, ``true_label``, ``pred_label`` and ``proba_<class>``.
    """
    ready = prepare_folds(df, features, label, fold, keep, **options)
    fitted = concurrently(df.sparkSession, [partial(ready.fit, estimator, f) for f in ready.parts])
    return reduce(DataFrame.unionByName, [ready.predict(m, f) for m, f in zip(fitted, ready.parts, strict=True)])


def refit(
    df: DataFrame, estimator: Estimator, features: Sequence[str], label: str = "label", weight: str | None = None
) -> PipelineModel:
    """Fit on every row (the model to save after cross-validation)."""
    ready = materialize(_with_text(df, label))
    return classifier_pipeline(estimator, features, label_order(ready, label), label, weight).fit(ready)


def oof_regress(
    df: DataFrame,
    targets: Sequence[str],
    features: Sequence[str],
    estimator: str = "forest",
    fold: str = "fold",
    trees: int = 400,
    seed: int = 42,
    min_rows: int = 10,
) -> DataFrame:
    """Add ``pred_<target>``: each fold predicted by a regression on the others.

    Missing features take the training median; a fold with fewer than ``min_rows`` finite targets and
    any other missing prediction take the median of the predictions.  A forest is grown and applied in
    tasks (:mod:`forest`): the driver holds no tree, however many rows or folds there are.
    """
    if estimator == "forest":
        return _middle_for_missing(_oof_forest(df, targets, features, fold, trees, seed, min_rows), targets)
    df = materialize(df)

    def predict(f) -> DataFrame:
        train, val = df.where(F.col(fold) != f), df.where(F.col(fold) == f)
        imputer = MedianImputer(features).fit(train)
        filled = imputer.transform(train)
        scaler = StandardScaler(features).fit(filled)
        prepared = materialize(scaler.transform(filled))
        ready = scaler.transform(imputer.transform(val.withColumns({f"_raw_{c}": F.col(c) for c in features})))
        for target in targets:
            known = prepared.where(finite(target).isNotNull())
            if known.limit(min_rows).count() < min_rows:
                ready = ready.withColumn(f"pred_{target}", F.lit(None).cast("double"))
                continue
            vector = VectorAssembler(inputCols=list(features), outputCol="_features")
            model = LinearRegression(featuresCol="_features", labelCol=target, predictionCol=f"pred_{target}")
            fitted = Pipeline(stages=[vector, model]).fit(known)
            ready = fitted.transform(ready).drop("_features")
        restored = ready.withColumns({c: F.col(f"_raw_{c}") for c in features})
        return restored.select(*val.columns, *[f"pred_{t}" for t in targets])

    out_parts = concurrently(df.sparkSession, [partial(predict, f) for f in folds_of(df, fold)])  # the folds are fitted side by side
    return _middle_for_missing(reduce(DataFrame.unionByName, out_parts), targets)


def _oof_forest(
    df: DataFrame, targets: Sequence[str], features: Sequence[str], fold: str, trees: int, seed: int, min_rows: int
) -> DataFrame:
    """The forests of :func:`oof_regress`: the folds are prepared in one pass for all and fitted side by side."""
    spark, columns = df.sparkSession, df.columns
    df = materialize(df.where(F.col(fold).isNotNull()).withColumn("_row", F.monotonically_increasing_id()))
    both, folds = _fold_rows(df.select(*dict.fromkeys(["_row", fold, *targets, *features])), features, fold, True, True)
    vector = VectorAssembler(inputCols=list(features), outputCol="_features").transform(both)
    known = [finite(t).alias(f"_y{i}") for i, t in enumerate(targets)]
    ready = materialize(vector.select("_of", "_train", "_row", *known, vector_to_array("_features").alias("_v")), ["_of", "_train"], _file_rows(features))

    def predict(f) -> dict:
        train, val = (ready.where((F.col("_of") == F.lit(f)) & (F.col("_train") == F.lit(t))) for t in (True, False))
        told = {}
        for i in range(len(targets)):
            rows = train.where(F.col(f"_y{i}").isNotNull()).select("_row", F.col(f"_y{i}").alias("_y"), "_v")
            n = rows.count()
            if n >= min_rows:
                told[i] = materialize(regression_forest.predict(rows, val.select("_row", "_v"), len(features), trees=trees, seed=seed + i, n=n))
        return told

    fitted = concurrently(spark, [partial(predict, f) for f in folds])  # the folds are fitted side by side
    for i, target in enumerate(targets):
        parts = [told[i].withColumnRenamed("prediction", f"pred_{target}") for told in fitted if i in told]
        if parts:
            df = df.join(reduce(DataFrame.unionByName, parts), "_row", "left")
        else:
            df = df.withColumn(f"pred_{target}", F.lit(None).cast("double"))
    return df.select(*columns, *[f"pred_{t}" for t in targets])


def _middle_for_missing(predicted: DataFrame, targets: Sequence[str]) -> DataFrame:
    """A missing prediction is the median of the others."""
    predicted = materialize(predicted)
    middle = quantiles(predicted, [], {f"_m_{t}": (f"pred_{t}", 0.5) for t in targets}).first()
    return predicted.withColumns(
        {f"pred_{t}": F.coalesce(finite(f"pred_{t}"), F.lit(middle[f"_m_{t}"]).cast("double")) for t in targets}
    )


# ---------------------------------------------------------------- search


def sample_space(space: Mapping[str, Sequence], n: int, seed: int = 42) -> list[dict]:
    """``n`` distinct random parameter settings (all of them when the space is smaller)."""
    rng = random.Random(seed)
    total = reduce(lambda a, values: a * len(values), space.values(), 1)
    seen: dict[tuple, dict] = {}
    while len(seen) < min(n, total):
        setting = {name: rng.choice(list(values)) for name, values in space.items()}
        seen.setdefault(tuple(setting.items()), setting)
    return list(seen.values())


def configured(estimator: Estimator, setting: Mapping) -> Estimator:
    copy = estimator.copy()
    for name, value in setting.items():
        copy.set(copy.getParam(name), value)
    return copy


# The usual space of a forest, as far as Spark ML has its settings.
FOREST_SPACE = {
    "numTrees": [400, 600, 800, 1000, 1200],
    "impurity": ["gini", "entropy"],
    "featureSubsetStrategy": ["sqrt", "log2", "all"],
    "maxDepth": [20, 30],
    "minInstancesPerNode": [2, 3, 4],
    "bootstrap": [True, False],
}


def macro_scores(counts: Mapping[tuple, int]) -> tuple[float, float]:
    """Macro F1 and accuracy of a table of (true, predicted) counts, as :func:`classification_metrics` has them."""
    return _macro(counts, {})


def _macro(counts: Mapping[tuple, int], rest: Mapping[str, int]) -> tuple[float, float]:
    """The same if ``rest`` further rows of each class were all predicted right: a bound on what can still be reached."""
    classes = sorted({c for pair in counts for c in pair} | set(rest))
    f1 = []
    for c in classes:
        hits = counts.get((c, c), 0) + rest.get(c, 0)
        sides = sum(n * ((t == c) + (p == c)) for (t, p), n in counts.items()) + 2 * rest.get(c, 0)
        f1.append(2 * hits / sides if sides else 0.0)
    n = sum(counts.values()) + sum(rest.values())
    right = sum(v for (t, p), v in counts.items() if t == p) + sum(rest.values())
    return (sum(f1) / len(f1), right / n) if n else (0.0, 0.0)


def evaluate_candidates(
    ready: PreparedFolds, candidates: Sequence[tuple[Estimator, Sequence[str]]], pooled: bool, stop_early: bool = False
) -> list[tuple[float, float] | None]:
    """Macro F1 and accuracy over the folds of every (estimator, features), fitted side by side.

    ``pooled`` scores the predictions of all folds together, otherwise the folds' scores are averaged.  With
    ``stop_early`` a candidate that could no longer reach the best finished one, were all its other rows
    predicted right, is given up (None): the best candidate and its score are the same as without.
    """
    spark = next(iter(ready.parts.values()))[0].sparkSession
    folds, supports = list(ready.parts), ready.supports()
    best = [float("-inf")]
    lock = Lock()

    def total(done: list[Counter]) -> tuple[float, float]:
        """The score so far, with the folds to come at their best."""
        rest = folds[len(done) :]
        if pooled:
            return _macro(sum(done, Counter()), sum((supports[f] for f in rest), Counter()))
        scores = [macro_scores(c) for c in done] + [(1.0, 1.0)] * len(rest)
        return tuple(sum(x) / len(folds) for x in zip(*scores, strict=True))

    def run(estimator: Estimator, features: Sequence[str]) -> tuple[float, float] | None:
        done: list[Counter] = []
        for f in folds:
            if stop_early and done and total(done)[0] < best[0]:
                return None
            done.append(ready.counts(estimator, f, features))
        with lock:
            best[0] = max(best[0], total(done)[0])
        return total(done)

    return concurrently(spark, [partial(run, e, c) for e, c in candidates])


def random_search(
    df: DataFrame,
    estimator: Estimator,
    features: Sequence[str],
    space: Mapping[str, Sequence],
    n: int,
    label: str = "label",
    fold: str = "fold",
    seed: int = 42,
    **options,
) -> tuple[DataFrame, list[dict]]:
    """Mean macro F1 and accuracy over grouped folds for sampled settings, best first.

    Returns the score table (``setting`` is the position in the returned list of settings).  ``options`` go to
    :func:`prepare_folds`, which runs once for all settings.
    """
    settings = sample_space(space, n, seed)
    ready = prepare_folds(df, features, label, fold, **options)
    found = evaluate_candidates(ready, [(configured(estimator, s), ready.features) for s in settings], pooled=False)
    rows = [(i, f1, accuracy) for i, (f1, accuracy) in enumerate(found)]
    scores = df.sparkSession.createDataFrame(rows, "setting int, f1_macro double, accuracy double")
    return scores.orderBy(F.desc("f1_macro"), "setting"), settings


def nested_cv(
    df: DataFrame,
    estimator: Estimator,
    features: Sequence[str],
    space: Mapping[str, Sequence],
    n: int = 5,
    inner: int = 3,
    label: str = "label",
    group: str = "subject",
    fold: str = "fold",
    keep: Sequence[str] = (),
    seed: int = 42,
    stratify: bool = False,
    **options,
) -> tuple[DataFrame, list[dict], dict]:
    """Search settings inside every outer training part, then predict the outer fold with the best.

    ``options`` go to :func:`prepare_folds` (imputing, normal quantiles, over-sampling, weights) of the inner and
    the outer folds alike; ``stratify`` keeps the classes even over the inner folds.  Returns out-of-fold
    predictions, the chosen setting and score per fold, and the consensus setting (most frequent over the
    folds, best inner score on a tie).  The outer folds are searched side by side, while their own training
    and validation rows are prepared.
    """
    spark, size = df.sparkSession, _file_rows(features)
    df = materialize(df, rows=size)
    settings = sample_space(space, n, seed)

    def search(f) -> dict:
        inner_folds = group_kfold(df.where(F.col(fold) != f), group, inner, stratify=label if stratify else None, fold="_inner")
        ready = prepare_folds(materialize(inner_folds, rows=size), features, label, "_inner", keep, **options)
        found = evaluate_candidates(ready, [(configured(estimator, s), ready.features) for s in settings], pooled=False, stop_early=True)
        top = max((i for i, x in enumerate(found) if x), key=lambda i: (found[i][0], -i))
        return {"fold": f, "setting": settings[top], "f1_macro": found[top][0]}

    prepare = partial(prepare_folds, df, features, label, fold, keep, **options)
    outer, *chosen = concurrently(spark, [prepare, *(partial(search, f) for f in folds_of(df, fold))])

    def predict(best: dict) -> DataFrame:
        return outer.predict(outer.fit(configured(estimator, best["setting"]), best["fold"]), best["fold"])

    parts = concurrently(spark, [partial(predict, best) for best in chosen])
    return reduce(DataFrame.unionByName, parts), chosen, consensus(chosen)


def consensus(chosen: Sequence[Mapping]) -> dict:
    """Most frequent setting; on a tie the one with the best score."""
    votes = Counter(tuple(sorted(c["setting"].items())) for c in chosen)
    best = {}
    for c in chosen:
        key = tuple(sorted(c["setting"].items()))
        best[key] = max(best.get(key, float("-inf")), c["f1_macro"])
    winner = max(votes, key=lambda key: (votes[key], best[key]))
    return dict(winner)


# ---------------------------------------------------------------- importance and selection


def importances(model: PipelineModel | Model, features: Sequence[str], spark) -> DataFrame:
    """Feature importances of a fitted forest, largest first."""
    forest_model = model.stages[-1] if isinstance(model, PipelineModel) else model
    values = forest_model.featureImportances.toArray()
    rows = [(name, float(v)) for name, v in zip(features, values, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def partner_rows(df: DataFrame, key: str, repeats: int, seed: int = 42) -> DataFrame:
    """``repeat, <key>, partner``: in every repeat each row is given another row's key, each exactly once.

    The row that is i-th in one hash order is given the row that is i-th in the repeat's own.  All orders are
    one sort by ranges, and one join on the places brings them together.  Keys must be unique.
    """
    hashes = F.array(*[portable_hash(1000 * seed + r, key) for r in range(repeats + 1)])
    copies = df.select(F.col(key).alias("_key"), F.posexplode(hashes).alias("_order", "_h"))
    n = df.count()
    placed = numbered(copies, [F.col("_order"), F.col("_h"), F.col("_key")], "_pos").withColumn("_pos", F.col("_pos") - F.col("_order") * F.lit(n))
    own = placed.where("_order = 0").select("_pos", F.col("_key").alias(key))
    others = placed.where("_order > 0").select("_pos", F.col("_order").alias("repeat"), F.col("_key").alias("partner"))
    return own.join(others, "_pos").select("repeat", key, "partner")


def permutation_importance(
    df: DataFrame,
    model: PipelineModel,
    features: Sequence[str],
    label: str = "label",
    key: str = "window_id",
    repeats: int = 5,
    rows: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Mean and std of the drop in macro F1 when a feature is shuffled.

    Every repeat shuffles whole rows once (:func:`partner_rows`); a row is then scored with each of its features
    taken from its partner, so all features and repeats are one pass over two joins.  A feature that no tree
    of a forest splits on cannot change a prediction: its drop is 0 without scoring.
    All rows are scored; ``rows`` asks for a seeded subset of that many instead.
    """
    columns, forest_model = model.stages[1].getInputCols(), model.stages[-1]
    used = [columns.index(f) for f in features]
    if hasattr(forest_model, "featureImportances"):
        split_on = forest_model.featureImportances.toArray()
        used = [i for i in used if split_on[i] > 0]
    subset = df if rows is None else numbered(df.withColumn("_h", portable_hash(seed, key)), [F.col("_h"), F.col(key)], "_pos").where(F.col("_pos") < rows).drop("_h", "_pos")
    classes = list(model.stages[0].labels)
    vectors = VectorAssembler(inputCols=columns, outputCol="_features", handleInvalid="error").transform(_with_text(subset, label))
    ready = materialize(vectors.select(key, F.col(label).cast("string").alias("_true"), vector_to_array("_features").alias("_v")))

    def counts(scored: DataFrame, by: list[str]) -> DataFrame:
        out = forest_model.transform(scored.withColumn("_features", array_to_vector("_v")))
        names = F.array(*[F.lit(c) for c in classes])
        return out.select(*by, F.col("_true").alias("true_label"), F.element_at(names, F.col("prediction").cast("int") + 1).alias("pred_label"))

    base = classification_metrics(counts(ready, [])).select(F.col("f1_macro").alias("_base"))
    spark = df.sparkSession
    every = spark.createDataFrame([(columns.index(f), f) for f in features], "_i int, feature string")
    if not used:
        return every.select("feature", F.lit(0.0).alias("importance_mean"), F.lit(0.0).alias("importance_std"))
    pairs = partner_rows(ready.select(key), key, repeats, seed)
    given = ready.select(F.col(key).alias("partner"), F.col("_v").alias("_w"))
    joined = materialize(pairs.join(ready, key).join(given, "partner").select("repeat", "_true", "_v", "_w"))
    spread = joined.repartition(F.col("repeat"), F.xxhash64("_v")).withColumn("_i", F.explode(F.array(*[F.lit(i) for i in used])))
    moved = F.concat(F.slice("_v", 1, F.col("_i")), F.slice("_w", F.col("_i") + 1, 1), F.slice("_v", F.col("_i") + 2, len(columns)))
    shuffled = spread.select("repeat", "_i", "_true", moved.alias("_v"))
    drops = classification_metrics(counts(shuffled, ["repeat", "_i"]), ["repeat", "_i"]).join(F.broadcast(base))  # one row
    drop = F.col("_base") - F.col("f1_macro")
    told = drops.groupBy("_i").agg(F.avg(drop).alias("importance_mean"), F.stddev_pop(drop).alias("importance_std"))
    return every.join(told, "_i", "left").select("feature", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("importance_mean", "importance_std")])


def rfe(
    df: DataFrame, estimator: Estimator, features: Sequence[str], n: int, label: str = "label", drop_share: float = 0.1
) -> list[str]:
    """Recursive elimination: refit and drop the least important features until ``n`` are left."""
    current = list(features)
    step = max(1, int(drop_share * len(current)))
    ready = materialize(MedianImputer(features).fit(df).transform(df))
    while len(current) > n:
        model = refit(ready, estimator, current, label)
        values = model.stages[-1].featureImportances.toArray()
        order = sorted(range(len(current)), key=lambda i: (values[i], current[i]))
        gone = set(order[: min(step, len(current) - n)])
        current = [c for i, c in enumerate(current) if i not in gone]
    return current


def forward_select(
    df: DataFrame,
    estimator: Estimator,
    start: Sequence[str],
    candidates: Sequence[str],
    max_n: int,
    label: str = "label",
    fold: str = "fold",
    **options,
) -> tuple[list[str], list[dict]]:
    """Greedy forward selection by macro F1 on (inner) folds; stops when no candidate improves it.

    The folds are prepared once for all features.  The candidates of a step are fitted side by side, and those
    that can no longer win are given up.
    """
    chosen = list(start)
    ready = prepare_folds(df, list(dict.fromkeys([*start, *candidates])), label, fold, **options)
    best = evaluate_candidates(ready, [(estimator, chosen)], pooled=True)[0][0] if chosen else float("-inf")
    steps = [{"features": list(chosen), "f1_macro": best}]
    while len(chosen) < max_n:
        names = [c for c in candidates if c not in chosen]
        found = evaluate_candidates(ready, [(estimator, [*chosen, c]) for c in names], pooled=True, stop_early=True)
        trials = [(x[0], c) for x, c in zip(found, names, strict=True) if x]
        if not trials:
            break
        top, name = max(trials)
        if top <= best:
            break
        best, chosen = top, [*chosen, name]
        steps.append({"features": list(chosen), "f1_macro": best})
    return chosen, steps


def score(
    df: DataFrame, model: PipelineModel | str, subjects: Sequence, label: str = "label", keep: Sequence[str] = ()
) -> DataFrame:
    """Predict held-out subjects with a saved (path) or fitted model."""
    from physio_spark.operators.project import keep_subjects

    fitted = PipelineModel.load(model) if isinstance(model, str) else model
    held_out = _with_text(keep_subjects(df, subjects), label)
    classes = list(fitted.stages[0].labels)
    return _readable(fitted.transform(held_out), classes, list(keep), label)


__all__ = [
    "FOREST_SPACE", "PreparedFolds", "consensus", "evaluate_candidates", "fold_metrics", "forest", "forward_select", "importances",
    "macro_scores", "nested_cv", "neural_net", "oof_classify", "oof_regress", "partner_rows", "permutation_importance",
    "prepare_folds", "random_search", "refit", "rfe", "sample_space", "score",
]

"""Cleaning, imputing and scaling of feature tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from physio_spark.functions.columns import finite, portable_hash
from physio_spark.operators.ordered import smallest
from physio_spark.operators.quantiles import GATHER_ROWS, quantiles
from physio_spark.operators.stats import column_profile


def normalize_time(
    df: DataFrame, t: str, by: Sequence[str] = ("subject",), unit: str = "auto", out: str = "time_ms"
) -> DataFrame:
    """Times in milliseconds.  ``auto``: a series whose largest time is below 1e5 is in seconds.

    The rule misreads recordings in milliseconds that are shorter than 100 s; name the unit there.
    """
    value = finite(t)
    if unit == "s":
        return df.withColumn(out, value * 1000.0)
    if unit == "ms":
        return df.withColumn(out, value)
    from physio_spark.operators.ordered import attach

    longest = df.groupBy(*by).agg(F.max(value).alias("_longest"))
    out_df = attach(df, longest, list(by), salts=8)
    scaled = F.when(F.col("_longest") < 1e5, value * 1000.0).otherwise(value)
    return out_df.withColumn(out, scaled).drop("_longest")


def clean(df: DataFrame, columns: Sequence[str], fill: float | None = 0.0) -> DataFrame:
    """NaN and the infinities become null, then ``fill`` (unless it is None)."""
    fixed = {c: finite(c) if fill is None else F.coalesce(finite(c), F.lit(float(fill))) for c in columns}
    return df.withColumns(fixed)


def empty_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns without a single finite value (one pass; only the names reach the driver)."""
    profile = column_profile(df, columns)
    return sorted(r["column"] for r in profile.where("non_null = 0").select("column").collect())


def constant_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at most one distinct value, null counting as a value."""
    profile = column_profile(df, columns)
    flat = (F.col("non_null") == 0) | ((F.col("non_null") == F.col("rows")) & (F.col("min") == F.col("max")))
    return sorted(r["column"] for r in profile.where(flat).select("column").collect())


def drop_empty(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*empty_columns(df, columns))


def drop_constant(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*constant_columns(df, columns))


@dataclass
class MedianImputer:
    """Exact median per column, learned on one frame and applied to any other."""

    columns: Sequence[str]
    max_rows: int | None = GATHER_ROWS
    medians: dict[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> MedianImputer:
        row = quantiles(df, [], {c: (c, 0.5) for c in self.columns}, self.max_rows).first()
        self.medians = {c: row[c] for c in self.columns}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        fill = {c: F.lit(self.medians[c]).cast("double") for c in self.columns}
        return df.withColumns({c: F.coalesce(finite(c), fill[c]) for c in self.columns})


@dataclass
class StandardScaler:
    """Zero mean, unit population deviation; a constant column is only centred."""

    columns: Sequence[str]
    moments: dict[str, tuple[float, float]] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> StandardScaler:
        row = df.agg(
            *[F.avg(finite(c)).alias(f"m_{c}") for c in self.columns],
            *[F.stddev_pop(finite(c)).alias(f"d_{c}") for c in self.columns],
        ).first()
        self.moments = {c: (row[f"m_{c}"] or 0.0, row[f"d_{c}"] or 1.0) for c in self.columns}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: (finite(c) - F.lit(self.moments[c][0])) / F.lit(self.moments[c][1]) for c in self.columns}
        )


# Coefficients of the published rational approximation of the inverse normal
# distribution (absolute error below 1.2e-9 relative), central and tail regions.
_CENTRAL_NUM = (
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
)
_CENTRAL_DEN = (
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
    6.680131188771972e01, -1.328068155288572e01, 1.0,
)
_TAIL_NUM = (
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
)
_TAIL_DEN = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def _polynomial(x, coefficients: Sequence[float]):
    """Of a column or of an array of numbers."""
    value = coefficients[0]
    for k in coefficients[1:]:
        value = value * x + k
    return value


def _normal_scores(p: np.ndarray) -> np.ndarray:
    """:func:`inverse_normal` of an array: many columns at once would make one expression too large to compile."""
    tail = lambda q: _polynomial(q, _TAIL_NUM) / _polynomial(q, _TAIL_DEN)
    q = p - 0.5
    central = q * _polynomial(q * q, _CENTRAL_NUM) / _polynomial(q * q, _CENTRAL_DEN)
    low, high = tail(np.sqrt(-2 * np.log(p))), -tail(np.sqrt(-2 * np.log(1 - p)))
    return np.where(p < 0.02425, low, np.where(p > 1 - 0.02425, high, central))


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution for a probability in (0, 1)."""
    q = p - 0.5
    r = q * q
    central = q * _polynomial(r, _CENTRAL_NUM) / _polynomial(r, _CENTRAL_DEN)
    low_q = F.sqrt(-2 * F.log(p))
    high_q = F.sqrt(-2 * F.log(1 - p))
    low = _polynomial(low_q, _TAIL_NUM) / _polynomial(low_q, _TAIL_DEN)
    high = -_polynomial(high_q, _TAIL_NUM) / _polynomial(high_q, _TAIL_DEN)
    return F.when(p < 0.02425, low).when(p > 1 - 0.02425, high).otherwise(central)


@dataclass
class QuantileNormalizer:
    """Map every column to a normal distribution through ``n`` learned quantiles.

    Between two knots the probability is interpolated; over a run of equal knots the middle of the
    run counts.  Probabilities are clipped to [1e-7, 1 - 1e-7].
    """

    columns: Sequence[str]
    n: int = 300
    max_rows: int | None = GATHER_ROWS
    knots: dict[str, list[float]] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> QuantileNormalizer:
        # columns as rows: one aggregate for all of them, whatever their number
        long = df.select(*[finite(c).alias(c) for c in self.columns]).unpivot([], list(self.columns), "column", "value")
        found = quantiles(long, ["column"], {f"q{i}": ("value", i / (self.n - 1)) for i in range(self.n)}, self.max_rows)
        self.knots = {r["column"]: [r[f"q{i}"] for i in range(self.n)] for r in found.collect()}  # a row for each column
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        edge = 1e-7
        columns, last = list(self.columns), self.n - 1
        knots = [np.asarray(self.knots[c], float) for c in columns]

        def place(own: np.ndarray, v: np.ndarray) -> np.ndarray:
            below, upto = np.searchsorted(own, v, "left"), np.searchsorted(own, v, "right")
            low, high = own[np.clip(below - 1, 0, last)], own[np.clip(below, 0, last)]
            gap = np.where(high > low, high - low, 1.0)
            between = below - 1 + (v - low) / gap
            p = np.where(upto > below, (below + upto - 1) / 2, between) / last
            return _normal_scores(np.clip(np.where(v <= own[0], 0.0, np.where(v >= own[-1], 1.0, p)), edge, 1 - edge))

        @F.pandas_udf("array<double>")
        def scores(rows: pd.Series) -> pd.Series:
            values = np.array([np.asarray(x, float) for x in rows]).reshape(len(rows), len(columns))
            return pd.Series(list(np.stack([place(k, values[:, i]) for i, k in enumerate(knots)], axis=1)))

        placed = df.withColumn("_scores", scores(F.array(*[F.coalesce(finite(c), F.lit(0.0)) for c in columns])))
        out = {c: F.when(finite(c).isNotNull(), F.get("_scores", F.lit(i))) for i, c in enumerate(columns)}
        return placed.withColumns(out).drop("_scores")


# ---------------------------------------------------------------- balancing


def class_counts(df: DataFrame, label: str) -> dict:
    """Rows per class (the number of classes is small; one row each reaches the driver)."""
    return {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}


def downsample_class(
    df: DataFrame, cls, target: str = "median", seed: int = 42, label: str = "label", key: Sequence[str] = ("window_id",)
) -> DataFrame:
    """Reduce one class to the smallest or the median size of the other classes.

    No change if the class is absent, alone or already small enough.  Rows are chosen by a seeded hash
    of ``key``, so the choice does not depend on partitioning; exactly the target number stays.
    """
    counts = class_counts(df, label)
    others = sorted(v for k, v in counts.items() if k != cls)
    if cls not in counts or not others:
        return df
    if target == "min":
        goal = others[0]
    elif target == "median":
        mid = len(others) // 2
        goal = int(others[mid] if len(others) % 2 else (others[mid - 1] + others[mid]) / 2)
    else:
        raise ValueError("target must be 'min' or 'median'")
    if counts[cls] <= goal:
        return df
    chosen = smallest(df.where(F.col(label) == cls), [], portable_hash(seed, *key), goal, key)
    kept = chosen.where("_chosen").drop("_chosen")
    return df.where(F.col(label).isNull() | (F.col(label) != cls)).unionByName(kept)


def sample_groups(df: DataFrame, k: int, seed: int, group: str = "subject", by: Sequence[str] = ("video",)) -> DataFrame:
    """Seeded choice of at most ``k`` groups (curves) per stimulus; all rows of a chosen group stay."""
    by = list(by)
    groups = df.select(*by, group).distinct()
    chosen = smallest(groups, by, portable_hash(seed, *by, group), k, [group]).where("_chosen")
    return df.join(chosen.select(*by, group), [*by, group], "left_semi")


def class_weights(df: DataFrame, label: str = "label", scheme: str = "balanced", out: str = "weight") -> DataFrame:
    """Add a weight per row: ``balanced`` n / (classes * count), or ``inverse`` 1 / count with mean 1
    over the classes."""
    counts = class_counts(df, label)
    total, classes = sum(counts.values()), len(counts)
    if scheme == "balanced":
        weights = {k: total / (classes * n) for k, n in counts.items()}
    else:
        raw = {k: 1.0 / (n + 1e-8) for k, n in counts.items()}
        mean = math.fsum(raw.values()) / classes
        weights = {k: v / mean for k, v in raw.items()}
    pairs = [x for k, w in weights.items() for x in (F.lit(k), F.lit(w))]
    return df.withColumn(out, F.create_map(*pairs)[F.col(label)])

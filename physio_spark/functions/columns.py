"""Column expressions: numeric hygiene, scalar helpers and label rules."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: ColumnLike) -> Column:
    """True for an ordinary number; false for null, NaN and the infinities (NaN sorts above them)."""
    return F.coalesce(F.abs(col(c).cast("double")) < F.lit(math.inf), F.lit(False))


def finite(c: ColumnLike) -> Column:
    """Map NaN and the infinities to null, so that aggregates skip them."""
    value = col(c).cast("double")
    return F.when(F.abs(value) < F.lit(math.inf), value)


def to_numeric(c: ColumnLike) -> Column:
    """Lenient cast: text that is no finite number becomes null."""
    return finite(col(c).try_cast("double"))


def clip(c: ColumnLike, low: float, high: float) -> Column:
    c = col(c)
    return F.when(c.isNull(), c).otherwise(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def clip_sigma(c: ColumnLike, k: float = 5.0) -> Column:
    """Clip an already standardised value to plus or minus ``k`` standard deviations."""
    return clip(c, -k, k)


def round_half_even(c: ColumnLike) -> Column:
    return F.rint(col(c))


def lerp(t: Column, t0: Column, v0: Column, t1: Column, v1: Column) -> Column:
    """Linear interpolation between two knots; a missing knot holds the other one's value."""
    inside = v0 + (t - t0).cast("double") / (t1 - t0).cast("double") * (v1 - v0)
    return (
        F.when(t0.isNull(), v1)
        .when(t1.isNull() | (t1 == t0) | (t == t0), v0)
        .otherwise(inside)
    )


def first_valid(*candidates: ColumnLike) -> Column:
    """First candidate that is finite and greater than zero (estimators in order of trust)."""
    return F.coalesce(*[F.when(is_finite(c) & (col(c) > 0), col(c).cast("double")) for c in candidates])


def slope_or_zero(y: Column, x: Column) -> Column:
    return F.coalesce(F.regr_slope(y, x), F.lit(0.0))


def mapping_column(key: ColumnLike, mapping: Mapping) -> Column:
    """Look a key up in a small fixed mapping; unmapped keys give null."""
    pairs: list[Column] = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.create_map(*pairs)[col(key)]


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [name for name, kind in df.dtypes if kind in kinds and name not in skip]


def portable_hash(seed: int, *keys: ColumnLike) -> Column:
    """Seeded pseudo-random order key that any engine with md5 reproduces."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))


def uniform(seed: int, *keys: ColumnLike) -> Column:
    """Deterministic number in [0, 1) from a seed and row keys; independent of partitioning."""
    bits = F.conv(F.substring(portable_hash(seed, *keys), 1, 12), 16, 10).cast("double")
    return bits / F.lit(float(16**12))

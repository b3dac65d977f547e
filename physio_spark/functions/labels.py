"""Label rules and the fixed stimulus tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from physio_spark.functions.columns import ColumnLike, col, is_finite

# Stimulus ids, their emotion classes and display names.
VIDEO_CLASS = {
    1: "amused",
    2: "amused",
    3: "bored",
    4: "bored",
    5: "relaxed",
    6: "relaxed",
    7: "scary",
    8: "scary",
}
PAUSE_CLASS = {10: "start", 11: "blu", 12: "end"}
PAUSE_NEUTRAL = {10: "neutral", 11: "neutral", 12: "neutral"}
PAUSE_IDS = (10, 11, 12)
DISPLAY_NAME = {
    1: "Amusing 1",
    2: "Amusing 2",
    3: "Boring 1",
    4: "Boring 2",
    5: "Relaxed 1",
    6: "Relaxed 2",
    7: "Scary 1",
    8: "Scary 2",
    10: "startVid",
    11: "bluVid",
    12: "endVid",
}
CLASSES = ("amused", "bored", "relaxed", "scary")
EXPERIMENTS = (
    ("scary", "amused"),
    ("bored", "relaxed"),
    ("scary", "bored"),
    ("amused", "bored"),
)


def va_label(
    valence: ColumnLike,
    arousal: ColumnLike,
    v_low: float = 4.0,
    v_high: float = 6.0,
    a_low: float = 4.0,
    a_high: float = 6.0,
) -> Column:
    """Emotion class from a valence / arousal rating.

    Missing ratings and ratings inside the closed rectangle are neutral.  Outside it, an axis beyond
    its band decides its own side; an axis within its band is split at its midpoint (ties go up).
    """
    v, a = col(valence), col(arousal)
    known = is_finite(v) & is_finite(a)
    inside = v.between(v_low, v_high) & a.between(a_low, a_high)
    mid_v, mid_a = (v_low + v_high) / 2, (a_low + a_high) / 2
    # A band is symmetric about its midpoint, so "beyond the band" and "past the midpoint" agree.
    pleasant, excited = v >= mid_v, a >= mid_a
    quadrant = (
        F.when(pleasant & excited, "amused").when(pleasant, "relaxed").when(excited, "scary").otherwise("bored")
    )
    return F.when(~known | inside, F.lit("neutral")).otherwise(quadrant)


def merge_labels(df: DataFrame, mapping: Mapping[str, str], column: str = "label") -> DataFrame:
    return df.replace(dict(mapping), subset=[column])


def category_of(name: ColumnLike) -> Column:
    """Display name without its variant number (``"Scary 2"`` gives ``"Scary"``)."""
    return F.regexp_replace(col(name), r"\s+\S+$", "")


def variant_of(name: ColumnLike) -> Column:
    """Variant number of a display name; 1 when it has none."""
    digits = F.regexp_extract(col(name), r"\b(\d+)\b", 1)
    return F.coalesce(digits.try_cast("int"), F.lit(1))


def binary_experiment(
    df: DataFrame, positive: str, negative: str, label: str = "label", out: str = "target"
) -> DataFrame:
    """Keep two classes and encode them as 1 and 0."""
    kept = df.where(F.col(label).isin(positive, negative))
    return kept.withColumn(out, (F.col(label) == positive).cast("int"))


def experiments(df: DataFrame, pairs: Sequence[tuple[str, str]] = EXPERIMENTS, label: str = "label"):
    """Named two-class experiments over one window table (a lazy mapping of name to frame)."""
    return {f"{pos}_vs_{neg}": binary_experiment(df, pos, neg, label) for pos, neg in pairs}

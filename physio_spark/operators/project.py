"""Column selection and row filters on window tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from physio_spark.functions.columns import any_of, col, finite

# Columns of a window table that describe the window rather than the signal.
META_COLUMNS = (
    "subject", "video", "video_id", "start_s", "end_s", "window_start_ms", "window_end_ms",
    "label", "label_valence", "label_arousal", "valence", "arousal", "fold",
)

# Channel name fragments of the named channel sets.
CHANNEL_SETS = {
    "no_emg": ("drop", ("emg",)),
    "eda_only": ("keep", ("eda", "gsr")),
    "ecg_only": ("keep", ("ecg",)),
    "no_rsp": ("drop", ("rsp",)),
    "no_gsr": ("drop", ("gsr", "eda")),
    "no_ecg": ("drop", ("ecg",)),
    "combined": ("keep", ("ecg", "gsr", "eda", "rsp", "skt")),
    "face": ("keep", ("emg_zygo", "emg_coru")),
}


def feature_columns(df: DataFrame, meta: Iterable[str] = META_COLUMNS) -> list[str]:
    """Every column that is neither meta data nor a label."""
    skip = set(meta)
    return [c for c in df.columns if c not in skip]


def select_features(
    df: DataFrame, whitelist: Sequence[str], meta: Iterable[str] = META_COLUMNS
) -> tuple[DataFrame, list[str]]:
    """Keep meta columns and the listed features; also return the listed features that are missing."""
    have = set(df.columns)
    kept = [c for c in df.columns if c in set(meta)] + [c for c in whitelist if c in have]
    return df.select(*dict.fromkeys(kept)), [c for c in whitelist if c not in have]


def channel_sets(channels: Sequence[str]) -> dict[str, list[str]]:
    """Named subsets of the channels.  A ``no_*`` set exists only where it really leaves something out."""
    sets = {"all_channels": list(channels)}
    for name, (rule, parts) in CHANNEL_SETS.items():
        hit = [c for c in channels if any(p in c.lower() for p in parts)]
        chosen = hit if rule == "keep" else [c for c in channels if c not in hit]
        if hit and chosen:
            sets[name] = chosen
    return sets


def select_channels(df: DataFrame, channels: Sequence[str], wanted: Sequence[str], tensor: str = "x") -> DataFrame:
    """Reduce a channel-major tensor column to the wanted channels, in the wanted order."""
    unknown = [c for c in wanted if c not in channels]
    if unknown:
        raise ValueError(f"unknown channels: {unknown}")
    places = F.array(*[F.lit(list(channels).index(c)) for c in wanted])
    return df.withColumn(tensor, F.transform(places, lambda i: F.get(F.col(tensor), i)))


def coalesce_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Canonical feature = first alias that exists and is not null."""
    out = []
    for name, names in aliases.items():
        present = [finite(c) for c in names if c in df.columns]
        out.append((F.coalesce(*present) if present else F.lit(None).cast("double")).alias(name))
    rest = [c for c in df.columns if c not in aliases]
    return df.select(*rest, *out)


def conform(df: DataFrame, columns: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Exactly the given columns in the given order; absent ones become null doubles (or the given type)."""
    types = columns if isinstance(columns, Mapping) else dict.fromkeys(columns, "double")
    return df.select(
        *[F.col(c) if c in df.columns else F.lit(None).cast(kind).alias(c) for c, kind in types.items()]
    )


def exclude_videos(df: DataFrame, ids: Sequence, column: str = "video") -> DataFrame:
    """Drop pause stimuli; ids may be numbers or text, rows without an id stay."""
    names = [str(i) for i in ids]
    return df.where(F.col(column).isNull() | ~F.col(column).cast("string").isin(names))


def keep_classes(df: DataFrame, classes: Sequence[str], label: str = "label") -> DataFrame:
    return df.where(F.col(label).isin(list(classes)))


def keep_subjects(df: DataFrame, subjects: Sequence | DataFrame, column: str = "subject") -> DataFrame:
    """Rows of the listed subjects; a frame of subjects is applied as a semi join."""
    if isinstance(subjects, DataFrame):
        return df.join(subjects.select(F.col(subjects.columns[0]).alias(column)).distinct(), column, "left_semi")
    return df.where(F.col(column).isin(list(subjects)))


def drop_subjects(df: DataFrame, subjects: Sequence | DataFrame, column: str = "subject") -> DataFrame:
    if isinstance(subjects, DataFrame):
        return df.join(subjects.select(F.col(subjects.columns[0]).alias(column)).distinct(), column, "left_anti")
    return df.where(F.col(column).isNull() | ~F.col(column).isin(list(subjects)))


def exclude_labels(df: DataFrame, labels: Sequence[str], column: str = "label") -> DataFrame:
    """Drop pause labels, whatever their case; rows without a label stay."""
    lowered = [x.lower() for x in labels]
    return df.where(F.col(column).isNull() | ~F.lower(F.col(column)).isin(lowered))


def positive_only(column: str):
    """The value where it is a positive finite number, else null (for aggregates over rates)."""
    return F.when(finite(column) > 0, finite(column))


def rows_with_any(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(any_of(col(c).isNotNull() for c in columns))

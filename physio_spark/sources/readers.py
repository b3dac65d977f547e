"""Readers for recordings, annotations, stimulus metadata and feature tables."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from physio_spark.functions.columns import to_numeric

log = logging.getLogger(__name__)

# Column names of the recordings and the alternates that are accepted for them.
CHANNELS = ("ecg", "bvp", "gsr", "rsp", "skt", "emg_zygo", "emg_coru", "emg_trap")
SAMPLE_ALIASES = {
    "t_ms": ("daqtime", "time_ms", "time", "*time*", "*ms*"),
    "video": ("video", "video_id", "*vid*"),
    "ecg": ("ecg",),
    "bvp": ("bvp", "ppg", "*pulse*"),
    "gsr": ("gsr", "eda", "*skin*"),
    "rsp": ("rsp",),
    "skt": ("skt", "*temp*"),
    "emg_zygo": ("emg_zygo",),
    "emg_coru": ("emg_coru",),
    "emg_trap": ("emg_trap",),
}
ANNOTATION_ALIASES = {
    "t_ms": ("jstime", "time_ms", "time", "*time*", "*ms*"),
    "valence": ("valence", "*val*"),
    "arousal": ("arousal", "*aro*"),
    "video": ("video", "video_id", "*vid*"),
}
CORRUPT = "_corrupt_record"
SUBJECT_PATTERN = r"(\d+)(?!.*\d)"


def find_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """First column that matches a candidate: exact name, any case, or ``*part*`` of the name."""
    lowered = {c.lower().strip(): c for c in reversed(columns)}
    for candidate in candidates:
        if candidate.startswith("*"):
            part = candidate.strip("*")
            for c in columns:
                if part in c.lower():
                    return c
        elif candidate in lowered:
            return lowered[candidate]
    return None


def resolve(
    df: DataFrame, aliases: Mapping[str, Sequence[str]], required: Sequence[str]
) -> dict[str, str]:
    """Map wanted names to existing columns; complain about required ones that are missing."""
    found: dict[str, str] = {}
    for name, candidates in aliases.items():
        free = [c for c in df.columns if c not in found.values()]
        hit = find_column(free, candidates)
        if hit:
            found[name] = hit
    missing = [name for name in required if name not in found]
    if missing:
        raise ValueError(f"missing columns: {missing}; have {df.columns}")
    return found


def _header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the first line that a file of the folder has.

    The folder is listed as one path: Spark's own look for a header checks and lists each file as a path of its own.
    """
    lines = spark.read.text(path)
    first = lines.where(F.length(F.trim("value")) > 0).select("value").first()
    if first is None:
        return spark.read.option("header", True).csv(path).columns
    names = spark.read.option("header", True).csv(spark.sparkContext.parallelize([first["value"]], 1)).columns
    folders = [c for c in lines.columns[1:] if c.lower() not in {n.lower() for n in names}]  # of folders named key=value
    return [*names, *folders]


def _csv(spark: SparkSession, path: str, bad_lines: str) -> DataFrame:
    """All columns as text, so no pass over the data is spent on guessing types.

    Rows with too few fields are kept, with nulls.  Rows with too many are dropped by ``skip``, cut by
    ``keep`` and an error in ``fail``.  A file whose header names other columns, or the same in another
    order, is an error in every mode, never read by position.
    """
    if bad_lines not in ("skip", "keep", "fail"):
        raise ValueError(f"bad_lines is skip, keep or fail, not {bad_lines}")
    names = _header(spark, path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, CORRUPT]])
    # A parser that splits off only the columns a query asks for would not see that a line is too long.
    reader = spark.read.option("header", True).option("enforceSchema", False).option("columnPruning", False)
    reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    read = reader.schema(schema).csv(path)
    if bad_lines == "keep":
        return read.drop(CORRUPT)
    # Commas inside quotes separate nothing.
    fields = F.size(F.split(F.regexp_replace(CORRUPT, r'"[^"]*"', ""), ","))
    # Spark refuses a query that reads nothing but the corrupt record, so the first column is read too.
    long = F.coalesce((fields > len(names)) & (F.length(F.coalesce(names[0], F.lit(""))) >= 0), F.lit(False))
    if bad_lines == "fail":
        message = F.concat(F.lit("line with too many fields: "), F.col(CORRUPT))
        return read.where(~F.when(long, F.raise_error(message).cast("boolean")).otherwise(False)).drop(CORRUPT)
    return read.where(~long).drop(CORRUPT)


def _with_subject(df: DataFrame) -> DataFrame:
    return df.withColumn("subject", F.regexp_extract("_metadata.file_name", SUBJECT_PATTERN, 1).try_cast("int"))


def _chosen(df: DataFrame, subjects: Sequence[int] | None) -> DataFrame:
    if subjects is None:
        return df.where(F.col("subject").isNotNull())
    return df.where(F.col("subject").isin([int(s) for s in subjects]))


def missing_subjects(df: DataFrame, subjects: Sequence[int]) -> list[int]:
    """Requested subjects without data (ids only); each one is logged."""
    have = {r["subject"] for r in df.select("subject").distinct().collect()}
    absent = sorted(set(subjects) - have)
    for s in absent:
        log.warning("no recording for subject %s, skipped", s)
    return absent


def read_samples(
    spark: SparkSession,
    path: str,
    subjects: Sequence[int] | None = None,
    bad_lines: str = "skip",
    channels: Sequence[str] | None = None,
) -> DataFrame:
    """Recordings of many subjects from one folder: ``subject, t (us), time_s, video, <channels>``.

    The subject id is the last number in the file name.
    """
    raw = _with_subject(_csv(spark, path, bad_lines))
    names = resolve(raw.drop("subject"), SAMPLE_ALIASES, ["t_ms", *(channels or ())])
    wanted = [c for c in (channels or CHANNELS) if c in names]
    ms = to_numeric(names["t_ms"])
    video = to_numeric(names["video"]).cast("int") if "video" in names else F.lit(None).cast("int")
    out = raw.select(
        "subject",
        F.round(ms * 1000).cast("bigint").alias("t"),
        (ms / 1000).alias("time_s"),
        video.alias("video"),
        *[to_numeric(names[c]).alias(c) for c in wanted],
    )
    return _chosen(out, subjects)


def read_annotations(
    spark: SparkSession, path: str, subjects: Sequence[int] | None = None, bad_lines: str = "skip"
) -> DataFrame:
    """Continuous ratings: ``subject, t (us), time_s, valence, arousal[, video]``."""
    raw = _with_subject(_csv(spark, path, bad_lines))
    names = resolve(raw.drop("subject"), ANNOTATION_ALIASES, ["t_ms", "valence", "arousal"])
    ms = to_numeric(names["t_ms"])
    extra = [to_numeric(names["video"]).cast("int").alias("video")] if "video" in names else []
    out = raw.select(
        "subject",
        F.round(ms * 1000).cast("bigint").alias("t"),
        (ms / 1000).alias("time_s"),
        to_numeric(names["valence"]).alias("valence"),
        to_numeric(names["arousal"]).alias("arousal"),
        *extra,
    )
    return _chosen(out, subjects)


def read_videos(spark: SparkSession, path: str) -> DataFrame:
    """Stimulus durations: tab-separated, quoted names, milliseconds; trailing tabs are tolerated."""
    raw = (
        spark.read.option("header", True)
        .option("sep", "\t")
        .option("quote", '"')
        .schema("video_name string, video_duration string")
        .csv(path)
    )
    return raw.select("video_name", to_numeric("video_duration").alias("video_duration"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature table by suffix: csv, csv.gz or parquet; a folder is read as parquet."""
    name = PurePosixPath(path.rstrip("/")).name.lower()
    if name.endswith((".csv", ".csv.gz")):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    return spark.read.parquet(path)

"""Joins that align a sampled series with a slower annotation series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from physio_spark.functions.columns import finite, lerp
from physio_spark.operators.ordered import scan
from physio_spark.operators.quantiles import mode_of


# Points of a bucket that are joined without being spread.
CROWDED = 10_000


def _knots(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    t: str,
    cols: Sequence[str],
    width: int,
) -> DataFrame:
    """Left rows with ``_b_<c>`` / ``_a_<c>``: the annotation knot at or before / after each of them."""
    by = list(by)
    probe = left.withColumn("_side", F.lit(1))
    ref = right.select(*by, t, *[finite(c).alias(f"_k_{c}") for c in cols], F.lit(0).alias("_side"))
    both = probe.unionByName(ref, allowMissingColumns=True)
    knot = {
        c: F.when(F.col(f"_k_{c}").isNotNull(), F.struct(F.col(t).alias("t"), F.col(f"_k_{c}").alias("v")))
        for c in cols
    }
    scanned = scan(
        both,
        by,
        [t, "_side"],
        width,
        last={f"_b_{c}": knot[c] for c in cols},
        ahead={f"_a_{c}": knot[c] for c in cols},
    )
    return scanned.where("_side = 1")


def interp_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str] = ("subject",),
    t: str = "t",
    cols: Sequence[str] = ("valence", "arousal"),
    *,
    width: int,
    round_cols: Sequence[str] = (),
    round_mode: str = "nearest",
) -> DataFrame:
    """Interpolating as-of join: every left row gets ``cols`` of the right series at its own time.

    Numeric columns are interpolated linearly and held at the first / last annotation outside their
    range.  ``round_cols`` carry identifiers: ``"nearest"`` takes the id of the closer annotation,
    ``"compat"`` rounds the interpolated number half-to-even, which can produce ids that lie between
    two real ones.  Both series are unioned and scanned; there is no range join.
    """
    wanted = list(cols) + [c for c in round_cols if c not in cols]
    rows = _knots(left, right, by, t, wanted, width)
    now = F.col(t)
    out: list[Column] = []
    for c in wanted:
        b, a = F.col(f"_b_{c}"), F.col(f"_a_{c}")
        value = lerp(now, b["t"], b["v"], a["t"], a["v"])
        if c in round_cols and round_mode == "nearest":
            closer = F.when(b.isNull() | (a["t"] - now < now - b["t"]), a["v"]).otherwise(b["v"])
            value = F.coalesce(closer, b["v"]).cast("int")
        elif c in round_cols:
            value = F.rint(value).cast("int")
        out.append(value.alias(c))
    keep = [c for c in left.columns if c not in wanted]
    return rows.select(*keep, *out)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    t: str,
    cols: Sequence[str],
    *,
    width: int,
    direction: str = "backward",
) -> DataFrame:
    """Plain as-of join: the last value at or before (``backward``) or first at or after (``forward``)."""
    probe_side, ref_side = (1, 0) if direction == "backward" else (0, 1)
    by = list(by)
    probe = left.drop(*cols).withColumn("_side", F.lit(probe_side))
    ref = right.select(*by, t, *[F.col(c).alias(f"_k_{c}") for c in cols], F.lit(ref_side).alias("_side"))
    values = {f"_v_{c}": F.col(f"_k_{c}") for c in cols}
    mode = {"last": values} if direction == "backward" else {"ahead": values}
    both = probe.unionByName(ref, allowMissingColumns=True)
    scanned = scan(both, by, [t, "_side"], width, **mode).where(F.col("_side") == probe_side)
    keep = [c for c in left.columns if c not in cols]
    return scanned.select(*keep, *[F.col(f"_v_{c}").alias(c) for c in cols])


def shift_labels(
    df: DataFrame,
    shift: int,
    by: Sequence[str] = ("subject",),
    t: str = "t",
    cols: Sequence[str] = ("valence", "arousal"),
    *,
    width: int,
) -> DataFrame:
    """Compensate annotation lag: each row takes the labels of the first row at or after ``t + shift``.

    Rows with no such row are dropped.  ``shift`` is in the integer unit of ``t``; 0 is the identity.
    """
    if shift == 0:
        return df
    probe = df.drop(*cols).withColumn("_own", F.col(t)).withColumn(t, F.col(t) + F.lit(int(shift)))
    later = asof_join(
        probe.withColumns({c: F.lit(None).cast("double") for c in cols}),
        df.withColumn("_hit", F.lit(1)),
        by,
        t,
        [*cols, "_hit"],
        width=width,
        direction="forward",
    )
    return (
        later.where("_hit is not null").drop("_hit", t).withColumnRenamed("_own", t).select(*df.columns)
    )


def interval_agg(
    windows: DataFrame,
    points: DataFrame,
    by: Sequence[str] = ("subject",),
    start: str = "start",
    end: str = "end",
    t: str = "t",
    means: Sequence[str] = ("valence", "arousal"),
    mode: str | None = None,
    *,
    width: int,
    salts: int | None = 8,
) -> DataFrame:
    """Mean of the points inside each closed interval [start, end]; intervals without points keep nulls.

    Both sides are cut into time buckets of ``width`` and joined on (series, bucket, salt); the salt
    spreads the points of a crowded bucket.  Points of one bucket are reduced before the buckets of a
    window are put together.  Every interval is copied for each salt; ``salts=None`` measures the fullest bucket
    and takes one for each CROWDED points, at most 8.
    """
    by = list(by)
    key = [*by, start, end]
    bucket = lambda c: F.floor(F.col(c) / F.lit(width))
    if salts is None:
        fullest = points.groupBy(*by, bucket(t).alias("_bucket")).count().agg(F.max("count")).first()[0] or 0
        salts = min(8, 1 + fullest // CROWDED)
    probes = (
        windows.select(*key)
        .distinct()
        .withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(end))))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    value_cols = list(means) + ([mode] if mode and mode not in means else [])
    pts = points.select(
        *by,
        F.col(t).alias("_pt"),
        *[F.col(c).alias(f"_p_{c}") for c in value_cols],
        bucket(t).alias("_bucket"),
        F.pmod(F.xxhash64(t), F.lit(salts)).cast("int").alias("_salt"),
    )
    hits = probes.join(pts, by + ["_bucket", "_salt"]).where(F.col("_pt").between(F.col(start), F.col(end)))
    result = hits.groupBy(*key).agg(
        *[F.avg(finite(f"_p_{c}")).alias(c) for c in means], F.count(F.lit(1)).alias("n_points")
    )
    out = windows.join(result, key, "left")
    if mode:
        picked = mode_of(hits, key, f"_p_{mode}", f"{mode}_mode")
        out = out.join(picked, key, "left")
    return out.withColumn("n_points", F.coalesce("n_points", F.lit(0)))


def map_labels(
    df: DataFrame,
    mapping: Mapping | DataFrame,
    key: str = "video",
    label: str = "label",
    on_missing: str = "drop",
) -> DataFrame:
    """Lookup join from an id to its label.

    ``on_missing``: ``"drop"`` removes unmapped rows, ``"keep"`` leaves a null label, ``"error"``
    fails the job on the first unmapped row that is evaluated.
    """
    if isinstance(mapping, DataFrame):
        table = mapping.select(F.col(mapping.columns[0]).alias(key), F.col(mapping.columns[1]).alias(label))
    else:
        kind = df.schema[key].dataType.simpleString()
        table = df.sparkSession.createDataFrame(
            [(k, str(v)) for k, v in mapping.items()],
            "k string, v string" if kind == "string" else "k bigint, v string",
        ).select(F.col("k").cast(kind).alias(key), F.col("v").alias(label))
    joined = df.drop(label).join(table, key, "left")
    if on_missing == "drop":
        return joined.where(F.col(label).isNotNull())
    if on_missing == "error":
        complain = F.raise_error(F.concat(F.lit(f"no label for {key} "), F.col(key).cast("string")))
        return joined.withColumn(label, F.when(F.col(label).isNull(), complain.cast("string")).otherwise(F.col(label)))
    return joined


def unmapped(df: DataFrame, mapping: Mapping, key: str = "video") -> DataFrame:
    """Report of ids that have no label, with their row counts."""
    known = [k for k in mapping]
    missing = df.where(F.col(key).isNull() | ~F.col(key).isin(known))
    return missing.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def assemble(meta: DataFrame, labels: DataFrame, features: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Put meta data, labels and features of the same windows side by side, matched on the window key."""
    keys = [key] if isinstance(key, str) else list(key)
    return meta.join(labels, keys).join(features, keys)


__all__ = [
    "asof_join",
    "assemble",
    "interp_join",
    "interval_agg",
    "map_labels",
    "shift_labels",
    "unmapped",
]

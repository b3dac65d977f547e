"""Queries: window and group statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from physio_spark.operators import stats as S
from physio_spark.operators.align import interp_join
from physio_spark.operators.panes import window_stats
from physio_spark.operators.quantiles import bracketed_quantiles, mode_of
from physio_spark.operators.windows import normalize_curve
from physio_spark.plans.adapter import (
    DAY,
    LENGTH,
    SQL_ANNOTATIONS,
    SQL_PREDICTIONS,
    SQL_SAMPLES,
    SQL_WINDOWS,
    STEP,
    annotations,
    blocked,
    orders_as_predictions,
    samples,
    table,
    width_of,
    windowed,
)
from physio_spark.plans.registry import final, query
from physio_spark.runtime import materialize

KEY = ["subject", "block", "win"]
FS = 2.0
WINDOW = ("win_start", "win_end")


def _window_stats(spark, sf_dir, spec, empty=0.0):
    b, width = blocked(spark, sf_dir)
    if set(spec) & S.NEEDS_NEIGHBOURS:
        b = S.with_neighbours(materialize(b), ["subject", "block"], ["value"], width=width)  # its rows are read twice
    return window_stats(b, ["subject", "block"], ["value"], spec, LENGTH, STEP, fs=FS, unit=float(DAY), empty=empty).drop(*WINDOW)


def _window_sql(exprs: dict[str, str], extra: str = "", source: str = "x") -> str:
    cols = ", ".join(f"{e} AS {n}" for n, e in exprs.items())
    return final(
        SQL_WINDOWS + extra,
        f"SELECT subject, block, win, count(*) AS n_rows, {cols} FROM {source} GROUP BY ALL",
        list(exprs),
        ["block"],
    )


ELAPSED = f"(t - win_start) / {DAY}::DOUBLE"
SLOPE = f"CASE WHEN count(*) < 2 THEN 0.0 ELSE coalesce(regr_slope(value, {ELAPSED}), 0.0) END"


@query(
    "agg1_base_stats",
    final(
        SQL_WINDOWS,
        f"SELECT subject, block, win, count(*) AS n_rows, avg(value) AS value_mean, stddev_pop(value) AS value_std0, "
        f"min(value) AS value_min, max(value) AS value_max, {SLOPE} AS value_slope FROM x GROUP BY subject, block, win",
        ["value_mean", "value_std0", "value_min", "value_max", "value_slope"],
        ["block"],
        digits=5,
    ),
    digits=5,
)
def agg1(spark, sf_dir):
    return _window_stats(spark, sf_dir, S.BASE)


@query(
    "agg2_extended_stats",
    final(
        SQL_WINDOWS,
        f"SELECT subject, block, win, count(*) AS n_rows, avg(value) AS value_mean, coalesce(stddev_samp(value), 0.0) AS value_std1, "
        f"min(value) AS value_min, max(value) AS value_max, median(value) AS value_median, "
        f"quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS value_iqr, max(value) - min(value) AS value_range, "
        f"{SLOPE} AS value_slope FROM x GROUP BY subject, block, win",
        ["value_mean", "value_std1", "value_min", "value_max", "value_median", "value_iqr", "value_range", "value_slope"],
        ["block"],
        digits=5,
    ),
    digits=5,
)
def agg2(spark, sf_dir):
    return _window_stats(spark, sf_dir, S.EXTENDED)


@query(
    "agg3_slope_by_index",
    _window_sql({"value_slope_fs": f"CASE WHEN count(*) < 2 THEN 0.0 ELSE coalesce(regr_slope(value, idx) * {FS}, 0.0) END"}),
)
def agg3(spark, sf_dir):
    return _window_stats(spark, sf_dir, ["slope_fs"])


@query(
    "agg4_fitted_slope",
    _window_sql({"value_slope_fit": "CASE WHEN count(*) >= 3 THEN coalesce(regr_slope(value, idx), 0.0) END"}),
)
def agg4(spark, sf_dir):
    return _window_stats(spark, sf_dir, ["slope_fit"])


SQL_MOMENTS = """
mo AS (SELECT *, avg(value) OVER (PARTITION BY subject, block, win) AS mu FROM x),
"""
M2, M3, M4 = (f"avg(power(value - mu, {k}))" for k in (2, 3, 4))


@query(
    "agg5_basic_block",
    _window_sql(
        {
            "value_min": "min(value)",
            "value_max": "max(value)",
            "value_mean": "avg(value)",
            "value_std0": "stddev_pop(value)",
            "value_median": "median(value)",
            "value_range": "max(value) - min(value)",
            "value_skew": f"CASE WHEN count(*) >= 3 THEN CASE WHEN {M2} > 0 THEN {M3} / power({M2}, 1.5) ELSE 0.0 END END",
            "value_kurtosis": f"CASE WHEN count(*) >= 4 THEN CASE WHEN {M2} > 0 THEN {M4} / power({M2}, 2) - 3 ELSE -3.0 END END",
        },
        SQL_MOMENTS,
        "mo",
    ),
)
def agg5(spark, sf_dir):
    return _window_stats(spark, sf_dir, S.BASIC_BLOCK)


@query(
    "agg6_area_under_curve",
    _window_sql({"value_auc": f"coalesce(sum((value + before) / 2) / {FS}, 0.0)"}),
)
def agg6(spark, sf_dir):
    return _window_stats(spark, sf_dir, ["auc"])


@query(
    "agg7_difference_stats",
    _window_sql(
        {
            "value_diff_mean": f"coalesce(avg((value - before) * {FS}), 0.0)",
            "value_diff_std0": f"coalesce(stddev_pop((value - before) * {FS}), 0.0)",
            "value_diff_std1": f"coalesce(stddev_samp((value - before) * {FS}), 0.0)",
            "value_diff_positive": "coalesce(avg(CASE WHEN before IS NULL THEN NULL WHEN value > before THEN 1.0 ELSE 0.0 END), 0.0)",
        }
    ),
)
def agg7(spark, sf_dir):
    return _window_stats(spark, sf_dir, ["diff_mean", "diff_std0", "diff_std1", "diff_positive"])


@query(
    "agg8_mode",
    final(
        SQL_WINDOWS
        + """c AS (SELECT subject, block, win, channel, count(*) AS n FROM x GROUP BY ALL),
             h AS (SELECT subject, block, win, CAST(floor(value / 20) AS BIGINT) AS level, count(*) AS n FROM x GROUP BY ALL),
             c1 AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY subject, block, win ORDER BY n DESC, channel) = 1),
             h1 AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY subject, block, win ORDER BY n DESC, level) = 1)""",
        "SELECT c1.subject, c1.block, c1.win, channel, level FROM c1 JOIN h1 USING (subject, block, win)",
        longs=["block"],
    ),
)
def agg8(spark, sf_dir):
    wd, _ = windowed(spark, sf_dir)
    leveled = wd.withColumn("bin", F.floor(F.col("value") / 20))
    return mode_of(leveled, KEY, "channel", "channel").join(mode_of(leveled, KEY, "bin", "level"), KEY)


@query(
    "agg9_zero_crossings",
    final(
        SQL_WINDOWS
        + """mo AS (SELECT *, avg(value) OVER (PARTITION BY subject, block, win) AS mu FROM x)""",
        f"SELECT subject, block, win, count(*) AS n_rows, sum(CASE WHEN before IS NOT NULL AND (value - mu < 0) <> (before - mu < 0) "
        f"THEN 1 ELSE 0 END) / greatest(count(*) / {FS}::DOUBLE, 1e-6) AS value_zero_crossings FROM mo GROUP BY subject, block, win",
        ["value_zero_crossings"],
        ["block"],
    ),
)
def agg9(spark, sf_dir):
    return _window_stats(spark, sf_dir, ["zero_crossings"])


@query(
    "agg10_breath_rate",
    _window_sql(
        {
            "value_breath_rate": "CASE WHEN count(*) < 3 THEN 0.0 ELSE sum(CASE WHEN value - before > 0 AND after - value <= 0 "
            f"THEN 1 ELSE 0 END) / (count(*) / {FS}::DOUBLE) * 60.0 END"
        }
    ),
)
def agg10(spark, sf_dir):
    return _window_stats(spark, sf_dir, ["breath_rate"])


@query(
    "agg11_median_deviation",
    final(
        SQL_WINDOWS + "me AS (SELECT *, median(value) OVER (PARTITION BY subject, block, win) AS med FROM x)",
        "SELECT subject, block, win, count(*) AS n_rows, median(abs(value - med)) AS value_mad FROM me GROUP BY subject, block, win",
        ["value_mad"],
        ["block"],
    ),
)
def agg11(spark, sf_dir):
    return _window_stats(spark, sf_dir, ["mad"])


SQL_RATED = (
    SQL_WINDOWS
    + SQL_ANNOTATIONS
    + """
p AS (SELECT x.*, a.t AS bt, a.valence AS bv, a.arousal AS ba FROM x ASOF LEFT JOIN a ON x.subject = a.subject AND x.t >= a.t),
q AS (SELECT p.*, a.t AS ct, a.valence AS cv, a.arousal AS ca FROM p ASOF LEFT JOIN a ON p.subject = a.subject AND p.t <= a.t),
z AS (SELECT subject, block, win, value, channel,
        CASE WHEN bt IS NULL THEN cv WHEN ct IS NULL OR ct = bt THEN bv ELSE bv + (t - bt)::DOUBLE / (ct - bt)::DOUBLE * (cv - bv) END AS valence,
        CASE WHEN bt IS NULL THEN ca WHEN ct IS NULL OR ct = bt THEN ba ELSE ba + (t - bt)::DOUBLE / (ct - bt)::DOUBLE * (ca - ba) END AS arousal
      FROM q),
"""
)


@query(
    "agg12_window_labels",
    final(
        SQL_RATED,
        "SELECT subject, block, win, avg(valence) AS label_valence, avg(arousal) AS label_arousal FROM z GROUP BY subject, block, win",
        ["label_valence", "label_arousal"],
        ["block"],
    ),
)
def agg12(spark, sf_dir):
    from physio_spark.operators.segment import blocks
    from physio_spark.operators.windows import time_windows

    s = samples(spark, sf_dir)
    width = width_of(s)
    rated = interp_join(s, annotations(s), width=width)
    wd = time_windows(blocks(rated, width=width), LENGTH, STEP)
    return wd.groupBy(*KEY).agg(F.avg("valence").alias("label_valence"), F.avg("arousal").alias("label_arousal"))


@query(
    "agg13_subject_video_features",
    final(
        SQL_SAMPLES + "mo AS (SELECT *, avg(value) OVER (PARTITION BY subject, video) AS mu FROM s)",
        "SELECT subject, video, count(*) AS n_rows, min(value) AS value_min, max(value) AS value_max, avg(value) AS value_mean, "
        "stddev_pop(value) AS value_std0, median(value) AS value_median, max(value) - min(value) AS value_range, "
        f"CASE WHEN count(*) >= 3 THEN CASE WHEN {M2} > 0 THEN {M3} / power({M2}, 1.5) ELSE 0.0 END END AS value_skew, "
        f"CASE WHEN count(*) >= 4 THEN CASE WHEN {M2} > 0 THEN {M4} / power({M2}, 2) - 3 ELSE -3.0 END END AS value_kurtosis "
        "FROM mo GROUP BY subject, video",
        ["value_min", "value_max", "value_mean", "value_std0", "value_median", "value_range", "value_skew", "value_kurtosis"],
        ["video"],
    ),
)
def agg13(spark, sf_dir):
    return S.subject_video_features(samples(spark, sf_dir), ["value"])


@query(
    "agg14_two_level_mean",
    final(
        SQL_SAMPLES + "i AS (SELECT subject, video, avg(value) AS value FROM s GROUP BY ALL)",
        "SELECT video, avg(value) AS value, count(*) AS n_groups FROM i GROUP BY video",
        ["value"],
        ["video"],
    ),
)
def agg14(spark, sf_dir):
    return S.two_level_mean(samples(spark, sf_dir), ["value"], ["subject", "video"], ["video"])


SQL_SUMMARY = """
q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q25, median(l_extendedprice) AS med,
             quantile_cont(l_extendedprice, 0.75) AS q75 FROM lineitem GROUP BY l_returnflag)
"""


@query(
    "agg15_category_summary",
    final(
        SQL_SUMMARY,
        "SELECT l_returnflag, avg(l_extendedprice) AS l_extendedprice_mean, stddev_samp(l_extendedprice) AS l_extendedprice_std, "
        "min(l_extendedprice) FILTER (WHERE l_extendedprice >= q25 - 1.5 * (q75 - q25)) AS l_extendedprice_low, "
        "max(l_extendedprice) FILTER (WHERE l_extendedprice <= q75 + 1.5 * (q75 - q25)) AS l_extendedprice_high, "
        "any_value(q25) AS l_extendedprice_q25, any_value(med) AS l_extendedprice_median, any_value(q75) AS l_extendedprice_q75 "
        "FROM lineitem JOIN q USING (l_returnflag) GROUP BY l_returnflag",
        [f"l_extendedprice_{n}" for n in ("mean", "std", "low", "high", "q25", "median", "q75")],
        digits=4,
    ),
    digits=4,
)
def agg15(spark, sf_dir):
    return S.category_summary(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_extendedprice"])


@query(
    "agg15_bracketed_quantiles",
    final(
        "",
        "SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, 0.1) AS p10, median(l_extendedprice) AS p50, "
        "quantile_cont(l_quantity, 0.9) AS q90 FROM lineitem GROUP BY ALL",
        ["p10", "p50", "q90"],
        digits=4,
    ),
    digits=4,
)
def agg15_bracketed(spark, sf_dir):
    """The path for groups that no single task may hold; the low resolution forces it on small data."""
    return bracketed_quantiles(
        table(spark, sf_dir, "lineitem"),
        ["l_returnflag", "l_linestatus"],
        {"p10": ("l_extendedprice", 0.1), "p50": ("l_extendedprice", 0.5), "q90": ("l_quantity", 0.9)},
        accuracy=1000,
    )


SQL_PROFILE = (
    SQL_SAMPLES
    + """
i AS (SELECT video, avg(value) AS mean, max(value) AS top, 7.0::DOUBLE AS flat FROM s GROUP BY video),
e AS (SELECT min(mean) AS m0, max(mean) AS m1, min(top) AS t0, max(top) AS t1 FROM i)
"""
)


@query(
    "agg16_minmax_profile",
    final(
        SQL_PROFILE,
        "SELECT video, (mean - m0) / (m1 - m0 + 1e-12) AS mean, (top - t0) / (t1 - t0 + 1e-12) AS top, 0.0 AS flat FROM i, e",
        ["mean", "top", "flat"],
        ["video"],
    ),
)
def agg16(spark, sf_dir):
    profile = samples(spark, sf_dir).groupBy("video").agg(
        F.avg("value").alias("mean"), F.max("value").alias("top"), F.lit(7.0).alias("flat")
    )
    return S.minmax_profile(profile, ["mean", "top", "flat"])


@query(
    "agg17_top_variance",
    final(
        "",
        "SELECT feature, variance FROM (SELECT 'l_quantity' AS feature, var_samp(l_quantity) AS variance FROM lineitem UNION ALL "
        "SELECT 'l_extendedprice', var_samp(l_extendedprice) FROM lineitem UNION ALL SELECT 'l_discount', var_samp(l_discount) FROM lineitem "
        "UNION ALL SELECT 'l_tax', var_samp(l_tax) FROM lineitem) ORDER BY variance DESC LIMIT 3",
        ["variance"],
        digits=3,
    ),
    digits=3,
)
def agg17(spark, sf_dir):
    return S.top_variance(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 3)


CURVE = 12
SQL_CURVE = (
    SQL_SAMPLES
    + f"""
i AS (SELECT subject, video, value, row_number() OVER v - 1 AS i, count(*) OVER (PARTITION BY subject, video) AS n
      FROM s WINDOW v AS (PARTITION BY subject, video ORDER BY t)),
g AS (SELECT DISTINCT subject, video, n, unnest(range(0, {CURVE})) AS point FROM i),
j AS (SELECT g.*, a.value AS lo, b.value AS hi, point * (g.n - 1) / {CURVE - 1}.0::DOUBLE - (point * (g.n - 1)) // {CURVE - 1} AS share FROM g
      JOIN i a ON a.subject = g.subject AND a.video = g.video AND a.i = (point * (g.n - 1)) // {CURVE - 1}
      LEFT JOIN i b ON b.subject = g.subject AND b.video = g.video AND b.i = a.i + 1),
k AS (SELECT subject, video, point, CASE WHEN hi IS NULL THEN lo ELSE lo + share * (hi - lo) END AS value FROM j)
"""
)


def _curve_sql(half: str) -> str:
    return final(
        SQL_CURVE,
        f"SELECT video, point, count(value) AS n, avg(value) AS mean, avg(value) - {half} AS low, avg(value) + {half} AS high "
        "FROM k GROUP BY video, point",
        ["mean", "low", "high"],
        ["video", "point"],
    )


def _curves(spark, sf_dir):
    s = samples(spark, sf_dir)
    return normalize_curve(s, ["subject", "video"], "value", CURVE, width=width_of(s))


@query("agg18_mean_curve_sd", _curve_sql("stddev_pop(value)"))
def agg18(spark, sf_dir):
    return S.mean_curve(_curves(spark, sf_dir))


@query("agg18_mean_curve_ci", _curve_sql("1.96 * stddev_pop(value) / sqrt(greatest(count(value), 1))"))
def agg18_ci(spark, sf_dir):
    return S.mean_curve(_curves(spark, sf_dir), band="ci")


@query(
    "agg19_channel_correlation",
    final(
        SQL_SAMPLES
        + SQL_ANNOTATIONS
        + """l AS (SELECT * FROM s WHERE channel <> 'view'),
p AS (SELECT l.*, a.t AS bt, a.valence AS bv, a.arousal AS ba FROM l ASOF LEFT JOIN a ON l.subject = a.subject AND l.t >= a.t),
q AS (SELECT p.*, a.t AS ct, a.valence AS cv, a.arousal AS ca FROM p ASOF LEFT JOIN a ON p.subject = a.subject AND p.t <= a.t),
z AS (SELECT channel, value,
        CASE WHEN bt IS NULL THEN cv WHEN ct IS NULL OR ct = bt THEN bv ELSE bv + (t - bt)::DOUBLE / (ct - bt)::DOUBLE * (cv - bv) END AS valence,
        CASE WHEN bt IS NULL THEN ca WHEN ct IS NULL OR ct = bt THEN ba ELSE ba + (t - bt)::DOUBLE / (ct - bt)::DOUBLE * (ca - ba) END AS arousal
      FROM q)""",
        "SELECT channel AS signal, 'value' AS channel, 'valence' AS target, corr(value, valence) AS correlation FROM z GROUP BY z.channel UNION ALL "
        "SELECT channel, 'value', 'arousal', corr(value, arousal) FROM z GROUP BY z.channel",
        ["correlation"],
    ),
)
def agg19(spark, sf_dir):
    s = samples(spark, sf_dir)
    rated = interp_join(s.where("channel <> 'view'"), annotations(s), width=width_of(s))
    out = rated.withColumnRenamed("channel", "signal")
    return S.channel_correlation(out, ["value"], ["valence", "arousal"], ["signal"])


@query(
    "agg20_prediction_correlation",
    final("", "SELECT l_returnflag, corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY l_returnflag", ["r"]),
)
def agg20(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag").agg(S.column_correlation("l_quantity", "l_extendedprice").alias("r"))


@query(
    "agg21_value_counts",
    final(SQL_PREDICTIONS, "SELECT subject, true_label, count(*) AS n FROM p GROUP BY ALL"),
)
def agg21(spark, sf_dir):
    return S.value_counts(orders_as_predictions(spark, sf_dir), ["subject", "true_label"])


@query(
    "agg21_top_counts",
    final("", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 10"),
)
def agg21_top(spark, sf_dir):
    return S.value_counts(table(spark, sf_dir, "lineitem"), ["l_suppkey"], 10)


def _describe_sql(c: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max, "
        f"quantile_cont({c}, 0.25) AS q25, median({c}) AS q50, quantile_cont({c}, 0.75) AS q75 FROM lineitem"
    )


NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "agg22_describe",
    final("", " UNION ALL ".join(_describe_sql(c) for c in NUMBERS), ["mean", "std", "min", "max", "q25", "q50", "q75"], digits=4),
    digits=4,
)
def agg22(spark, sf_dir):
    return S.describe(table(spark, sf_dir, "lineitem"), NUMBERS)


@query(
    "agg23_column_profile",
    final(
        "",
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) AS \"rows\", count({e}) AS non_null, min({e}) AS min, max({e}) AS max FROM lineitem"
            for c, e in (("l_quantity", "l_quantity"), ("half", "CASE WHEN l_tax > 0.02 THEN l_tax END"), ("none", "CASE WHEN l_tax < 0 THEN l_tax END"))
        ),
        ["min", "max"],
    ),
)
def agg23(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_quantity",
        F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("half"),
        F.when(F.col("l_tax") < 0, F.col("l_tax")).alias("none"),
    )
    return S.column_profile(li, ["l_quantity", "half", "none"])

"""Queries: segmentation, windows and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from physio_spark.functions.labels import VIDEO_CLASS
from physio_spark.operators import segment, windows
from physio_spark.operators.align import map_labels
from physio_spark.operators.panes import window_stats
from physio_spark.operators.quantiles import mode_of
from physio_spark.operators.stats import BASE
from physio_spark.plans.adapter import (
    DAY,
    LENGTH,
    SQL_SAMPLES,
    SQL_WINDOWS,
    STEP,
    blocked,
    samples,
    sql_blocks,
    table,
    width_of,
    windowed,
)
from physio_spark.plans.registry import final, query

MS = 1000
SQL_LABELS = (
    "m(video, label) AS (VALUES (1, 'amused'), (2, 'amused'), (3, 'bored'), (4, 'bored'), "
    "(5, 'relaxed'), (6, 'relaxed'), (7, 'scary'), (8, 'scary'))"
)


@query(
    "win1_blocks",
    final(SQL_SAMPLES + sql_blocks("channel"), "SELECT b1.subject, b1.event_id, b1.block, seg.t0 AS block_start, "
          "seg.t1 AS block_end FROM b1 JOIN seg USING (subject, block)", longs=["block"]),
)
def win1(spark, sf_dir):
    return blocked(spark, sf_dir, "channel")[0].select("subject", "event_id", "block", "block_start", "block_end")


@query(
    "win2_segments",
    final(SQL_SAMPLES + sql_blocks("channel"), "SELECT subject, block, channel, t0 AS start, t1 AS \"end\", n, t1 - t0 AS duration FROM seg",
          longs=["block"]),
)
def win2(spark, sf_dir):
    return segment.segments(blocked(spark, sf_dir, "channel")[0], key="channel")


@query(
    "win3_time_windows",
    final(
        SQL_WINDOWS + SQL_LABELS,
        f"""SELECT x.subject, x.block, x.win, x.win_start, x.win_end, m.label, count(*) AS n_rows, avg(value) AS value_mean,
                   stddev_pop(value) AS value_std0, min(value) AS value_min, max(value) AS value_max,
                   coalesce(regr_slope(value, (t - win_start) / {DAY}::DOUBLE), 0.0) AS value_slope
            FROM x JOIN m ON m.video = x.video GROUP BY ALL HAVING count(*) > 1""",
        ["value_mean", "value_std0", "value_min", "value_max", "value_slope"],
        ["block"],
        digits=5,
    ),
    digits=5,
)
def win3(spark, sf_dir):
    b, _ = blocked(spark, sf_dir)
    out = window_stats(b, ["subject", "block", "video"], ["value"], BASE, LENGTH, STEP, unit=float(DAY)).where("n_rows > 1")
    return map_labels(out, VIDEO_CLASS).drop("video")


@query(
    "win4_video_windows",
    final(
        SQL_SAMPLES
        + f"""seg AS (SELECT subject, video, min(t) AS t0, max(t) AS t1 FROM s GROUP BY ALL),
              w AS (SELECT *, t0 + win * {STEP} AS win_start FROM (SELECT *, unnest(range(0, 5)) AS win FROM seg)
                    WHERE t0 + win * {STEP} < t1 - {LENGTH} + {MS}),
              x AS (SELECT w.*, s.t, s.value FROM w JOIN s ON s.subject = w.subject AND s.video = w.video
                    AND s.t >= w.win_start AND s.t < w.win_start + {LENGTH})""",
        "SELECT subject, video, win, win_start, count(*) AS n, avg(value) AS mean FROM x GROUP BY ALL "
        "HAVING count(*) >= 5 AND count(DISTINCT t) >= 2",
        ["mean"],
        ["video"],
    ),
)
def win4(spark, sf_dir):
    s = samples(spark, sf_dir)
    wd = windows.video_windows(s, LENGTH, STEP, width=width_of(s), slack=MS)
    by = ["subject", "video", "win", "win_start"]
    kept = windows.enough_rows(wd, by, 5, distinct_times=True)
    return kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


@query(
    "win5_count_windows",
    final(
        SQL_SAMPLES
        + """r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY t) - 1 AS idx,
                          count(*) OVER (PARTITION BY subject) AS total FROM s),
             w AS (SELECT DISTINCT subject, win FROM (SELECT subject, total, unnest(range(0, total // 5 + 1)) AS win
                   FROM (SELECT DISTINCT subject, total FROM r)) WHERE win * 5 + 20 <= total),
             x AS (SELECT r.*, w.win FROM w JOIN r ON r.subject = w.subject AND idx >= win * 5 AND idx < win * 5 + 20),
             a AS (SELECT subject, win, min(t) AS start, max(t) AS "end", avg(value) AS mean FROM x GROUP BY ALL),
             v AS (SELECT subject, win, video FROM x GROUP BY subject, win, video
                   QUALIFY row_number() OVER (PARTITION BY subject, win ORDER BY count(*) DESC, video) = 1)""",
        "SELECT a.*, v.video FROM a JOIN v USING (subject, win)",
        ["mean"],
        ["video"],
    ),
)
def win5(spark, sf_dir):
    s = samples(spark, sf_dir)
    wd = windows.count_windows(s, 10.0, 2.5, 2.0, width=width_of(s))
    by = ["subject", "win"]
    means = wd.groupBy(*by).agg(F.min("t").alias("start"), F.max("t").alias("end"), F.avg("value").alias("mean"))
    return means.join(mode_of(wd, by, "video", "video"), by)


MACRO_S, MACRO_HOP_S = 4 * 86400, 86400


def _windows_table(spark, sf_dir):
    """Short windows over the whole recording of a subject, labelled by stimulus."""
    s = samples(spark, sf_dir)
    wd = windows.count_windows(s, 3.0, 1.0, 1.0, width=width_of(s))
    by = ["subject", "win"]
    means = wd.groupBy(*by).agg(
        F.floor(F.min("t") / 1000).alias("window_start_ms"),
        F.floor(F.max("t") / 1000).alias("window_end_ms"),
        F.avg("value").alias("value_mean"),
    )
    return map_labels(means.join(mode_of(wd, by, "video", "video"), by), VIDEO_CLASS)


SQL_TABLE = (
    SQL_SAMPLES
    + SQL_LABELS
    + """,
r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY t) - 1 AS idx,
             count(*) OVER (PARTITION BY subject) AS total FROM s),
w0 AS (SELECT a.subject, a.idx AS win, b.t, b.value, b.video FROM r a JOIN r b
       ON b.subject = a.subject AND b.idx >= a.idx AND b.idx < a.idx + 3 AND a.idx + 3 <= a.total),
w1 AS (SELECT subject, win, min(t) // 1000 AS window_start_ms, max(t) // 1000 AS window_end_ms, avg(value) AS value_mean
       FROM w0 GROUP BY ALL),
w2 AS (SELECT subject, win, video FROM w0 GROUP BY subject, win, video
       QUALIFY row_number() OVER (PARTITION BY subject, win ORDER BY count(*) DESC, video) = 1),
wt AS (SELECT w1.*, w2.video, m.label FROM w1 JOIN w2 USING (subject, win) JOIN m ON m.video = w2.video),
"""
)


@query(
    "win6_macro_windows",
    final(
        SQL_TABLE
        + f"""f AS (SELECT subject, min(window_start_ms) AS first, max(window_start_ms) AS final FROM wt GROUP BY subject),
              k AS (SELECT subject, first + macro * {MACRO_HOP_S * 1000} AS ms, macro FROM
                    (SELECT *, unnest(range(0, (final - first) // {MACRO_HOP_S * 1000} + 1)) AS macro FROM f)),
              j AS (SELECT k.macro, k.ms, wt.* FROM k JOIN wt ON wt.subject = k.subject AND window_start_ms >= ms
                    AND window_start_ms < ms + {MACRO_S * 1000}),
              g AS (SELECT subject, macro, ms AS macro_start_ms, count(*) AS n_windows, avg(value_mean) AS value_mean
                    FROM j GROUP BY ALL HAVING count(*) >= greatest(3, {MACRO_S * 1000} // 100000000)),
              v AS (SELECT subject, macro, label FROM j GROUP BY subject, macro, label
                    QUALIFY row_number() OVER (PARTITION BY subject, macro ORDER BY count(*) DESC, label) = 1)""",
        "SELECT g.*, v.label FROM g JOIN v USING (subject, macro)",
        ["value_mean"],
    ),
)
def win6(spark, sf_dir):
    # The rule "one window per ten seconds" is meant for short windows; days need their own spacing.
    out = windows.macro_windows(
        _windows_table(spark, sf_dir), MACRO_S, MACRO_HOP_S, ["value_mean"], by=["subject"], spacing_ms=100_000_000
    )
    return out.select("subject", "macro", "macro_start_ms", "n_windows", "value_mean", "label")


@query(
    "win7_macro_windows_by_rows",
    final(
        SQL_TABLE
        + """i AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY win) - 1 AS i FROM wt),
             c AS (SELECT subject, max(i) AS top FROM i GROUP BY subject),
             k AS (SELECT subject, unnest(range(0, top // 30 + 1)) AS macro FROM c),
             j AS (SELECT k.macro, i.* FROM k JOIN i ON i.subject = k.subject AND i >= macro * 30 AND i < macro * 30 + 60),
             g AS (SELECT subject, macro, count(*) AS n_windows, avg(value_mean) AS value_mean FROM j GROUP BY ALL
                   HAVING count(*) >= 12),
             v AS (SELECT subject, macro, label FROM j GROUP BY subject, macro, label
                   QUALIFY row_number() OVER (PARTITION BY subject, macro ORDER BY count(*) DESC, label) = 1)""",
        "SELECT g.*, v.label FROM g JOIN v USING (subject, macro)",
        ["value_mean"],
    ),
)
def win7(spark, sf_dir):
    out = windows.macro_windows(
        _windows_table(spark, sf_dir), 40, 20, ["value_mean"], by=["subject"], start=None, order=["win"]
    )
    return out.select("subject", "macro", "n_windows", "value_mean", "label")


@query(
    "win8_sampling_rate",
    final(
        SQL_SAMPLES + "g AS (SELECT subject, t - lag(t) OVER (PARTITION BY subject ORDER BY t) AS gap FROM s)",
        f"SELECT subject, CASE WHEN median(gap) > 0 THEN {DAY}::DOUBLE / median(gap) ELSE 0.0 END AS fs, "
        f"CASE WHEN median(gap) > 0 THEN greatest(1.0, round_even({DAY}::DOUBLE / median(gap), 0)) ELSE 1000.0 END AS fs_int, "
        f"CASE WHEN count(*) >= 3 THEN {DAY}::DOUBLE / (median(gap) FILTER (WHERE gap > 0)) ELSE 1000.0 END AS fs_pos "
        "FROM g GROUP BY subject",
        ["fs", "fs_int", "fs_pos"],
    ),
)
def win8(spark, sf_dir):
    s = samples(spark, sf_dir)
    width = width_of(s)
    rate = lambda variant, name: segment.sampling_rate(
        s, ["subject"], width=width, units_per_second=float(DAY), variant=variant
    ).withColumnRenamed("fs", name)
    both = rate("window", "fs").join(rate("integer", "fs_int"), "subject")
    return both.join(rate("positive", "fs_pos"), "subject")


GRID = 16

SQL_GRID = (
    SQL_WINDOWS
    + f"""
ok AS (SELECT subject, block, win, win_start FROM x GROUP BY ALL HAVING count(value) >= 2),
g AS (SELECT *, win_start + point * {LENGTH // GRID} AS t FROM (SELECT *, unnest(range(0, {GRID})) AS point FROM ok)),
xs AS (SELECT subject, block, win, t, value FROM x),
p AS (SELECT g.*, xs.t AS bt, xs.value AS bv FROM g ASOF LEFT JOIN xs
      ON g.subject = xs.subject AND g.block = xs.block AND g.win = xs.win AND g.t >= xs.t),
q AS (SELECT p.*, xs.t AS ct, xs.value AS cv FROM p ASOF LEFT JOIN xs
      ON p.subject = xs.subject AND p.block = xs.block AND p.win = xs.win AND p.t <= xs.t),
"""
)


@query(
    "win9_window_tensor",
    final(
        SQL_GRID,
        "SELECT subject, block, win, point, CASE WHEN bt IS NULL THEN cv WHEN ct IS NULL OR ct = bt THEN bv "
        "ELSE bv + (t - bt)::DOUBLE / (ct - bt)::DOUBLE * (cv - bv) END AS value FROM q",
        ["value"],
        ["block", "point"],
    ),
)
def win9(spark, sf_dir):
    wd, width = windowed(spark, sf_dir)
    by = ["subject", "block", "win"]
    grid = windows.window_grid(wd, by, ["value"], LENGTH, GRID, width=width)
    return grid.select(*by, "point", "value")


CURVE = 12


@query(
    "win10_normalize_curve",
    final(
        SQL_SAMPLES
        + f"""i AS (SELECT subject, video, value, row_number() OVER v - 1 AS i, count(*) OVER (PARTITION BY subject, video) AS n
                    FROM s WINDOW v AS (PARTITION BY subject, video ORDER BY t)),
              g AS (SELECT subject, video, n, point, point * (n - 1) / {CURVE - 1}.0::DOUBLE AS pos
                    FROM (SELECT DISTINCT subject, video, n, unnest(range(0, {CURVE})) AS point FROM i)),
              j AS (SELECT g.*, a.value AS lo, b.value AS hi, pos - (point * (g.n - 1)) // {CURVE - 1} AS share FROM g
                    JOIN i a ON a.subject = g.subject AND a.video = g.video AND a.i = (point * (g.n - 1)) // {CURVE - 1}
                    LEFT JOIN i b ON b.subject = g.subject AND b.video = g.video AND b.i = a.i + 1)""",
        "SELECT subject, video, point, CASE WHEN hi IS NULL THEN lo ELSE lo + share * (hi - lo) END AS value FROM j",
        ["value"],
        ["video", "point"],
    ),
)
def win10(spark, sf_dir):
    s = samples(spark, sf_dir)
    return windows.normalize_curve(s, ["subject", "video"], "value", CURVE, width=width_of(s))


@query(
    "win11_time_normalize",
    final(
        SQL_SAMPLES
        + sql_blocks()
        + f"""gap AS (SELECT subject, block, t - lag(t) OVER (PARTITION BY subject, block ORDER BY t) AS d FROM b1),
              fs AS (SELECT subject, block, median(d) AS d FROM gap GROUP BY ALL),
              len AS (SELECT subject, median((t1 - t0) / {DAY}::DOUBLE) AS len FROM seg GROUP BY subject),
              k AS (SELECT seg.subject, seg.block, t0, len, greatest(2, CAST(round_even(len * CASE WHEN d > 0 THEN {DAY}::DOUBLE / d
                           ELSE 20.0 END, 0) AS BIGINT)) AS n, min(t0) OVER (PARTITION BY seg.subject) / {DAY}::DOUBLE AS origin
                    FROM seg JOIN fs USING (subject, block) JOIN len USING (subject)),
              c AS (SELECT *, len / (n - 1) AS hop, origin + coalesce(sum(len + len / (n - 1)) OVER (PARTITION BY subject
                    ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM k),
              g AS (SELECT subject, block, point, point * hop AS t, cur + point * hop AS time_s
                    FROM (SELECT *, unnest(range(0, n)) AS point FROM c)),
              xs AS (SELECT b1.subject, b1.block, (b1.t - seg.t0) / {DAY}::DOUBLE AS t, b1.value FROM b1 JOIN seg USING (subject, block)),
              p AS (SELECT g.*, xs.t AS bt, xs.value AS bv FROM g ASOF LEFT JOIN xs
                    ON g.subject = xs.subject AND g.block = xs.block AND g.t >= xs.t),
              q AS (SELECT p.*, xs.t AS ct, xs.value AS cv FROM p ASOF LEFT JOIN xs
                    ON p.subject = xs.subject AND p.block = xs.block AND p.t <= xs.t)""",
        "SELECT subject, block, point, time_s, CASE WHEN bt IS NULL THEN cv WHEN ct IS NULL OR ct = bt THEN bv "
        "ELSE bv + (t - bt) / (ct - bt) * (cv - bv) END AS value FROM q",
        ["time_s", "value"],
        ["block"],
        digits=5,
    ),
    digits=5,
)
def win11(spark, sf_dir):
    b, width = blocked(spark, sf_dir)
    out = windows.time_normalize(b, ["value"], width=width, units_per_second=float(DAY))
    return out.select("subject", "block", "point", "time_s", "value")


SERIAL_ORDER = (7, 3, 1, 5)


@query(
    "win12_serial_timeline",
    final(
        SQL_SAMPLES
        + sql_blocks()
        + "o(video, position) AS (VALUES (7, 1), (3, 2), (1, 3), (5, 4))",
        "SELECT subject, seg.video, position, t1 - t0 AS duration, coalesce(sum(t1 - t0) OVER (PARTITION BY subject "
        "ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS \"offset\" "
        "FROM seg JOIN o ON o.video = seg.video",
        longs=["video", "position", '"offset"'],
    ),
)
def win12(spark, sf_dir):
    b, _ = blocked(spark, sf_dir)
    out = segment.serial_timeline(segment.segments(b), SERIAL_ORDER)
    return out.select("subject", "video", "position", "duration", "offset")


SQL_SECONDS = (
    SQL_WINDOWS
    + f"""
d AS (SELECT DISTINCT subject, video, win, win_start / {DAY}::DOUBLE AS start_s, win_end / {DAY}::DOUBLE AS end_s FROM x),
"""
)


def _in_days(spark, sf_dir):
    wd, _ = windowed(spark, sf_dir)
    return wd.select(
        "subject", "video", "win",
        (F.col("win_start") / float(DAY)).alias("start_s"),
        (F.col("win_end") / float(DAY)).alias("end_s"),
    ).distinct()


@query(
    "win12_cumulative_axis",
    final(
        SQL_SECONDS
        + """v AS (SELECT subject, video, min(start_s) AS s0, greatest(1e-6, max(end_s) - min(start_s)) AS dur FROM d GROUP BY ALL),
             o AS (SELECT *, coalesce(sum(dur) OVER (PARTITION BY subject ORDER BY s0 ROWS BETWEEN UNBOUNDED PRECEDING
                   AND 1 PRECEDING), 0) AS offset_s FROM v)""",
        "SELECT d.subject, d.video, d.win, o.offset_s, o.offset_s + d.end_s - o.s0 AS axis_s FROM d JOIN o USING (subject, video)",
        ["offset_s", "axis_s"],
        ["video"],
    ),
)
def win12_axis(spark, sf_dir):
    return segment.cumulative_axis(_in_days(spark, sf_dir)).select("subject", "video", "win", "offset_s", "axis_s")


@query(
    "win13_relative_axis",
    final(
        SQL_SECONDS
        + f"""e AS (SELECT d.subject, d.video, win, CASE WHEN d.video % 2 = 0 THEN end_s - t0 / {DAY}::DOUBLE ELSE end_s END AS end_s
                    FROM d JOIN seg USING (subject, video)),
              v AS (SELECT subject, video, t0 / {DAY}::DOUBLE AS start, (t1 - t0) / {DAY}::DOUBLE AS dur FROM seg),
              o AS (SELECT *, coalesce(sum(dur) OVER (PARTITION BY subject ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING
                    AND 1 PRECEDING), 0) AS offset_s FROM v),
              r AS (SELECT subject, video, avg(CASE WHEN end_s <= 1.1 * dur THEN 1 ELSE 0 END) >= 0.8 AS relative
                    FROM e JOIN v USING (subject, video) GROUP BY ALL)""",
        "SELECT subject, video, win, relative, offset_s + greatest(0.0, least(dur, CASE WHEN relative THEN end_s ELSE "
        "end_s - start END)) AS axis_s FROM e JOIN o USING (subject, video) JOIN r USING (subject, video)",
        ["axis_s"],
        ["video"],
    ),
)
def win13(spark, sf_dir):
    b, _ = blocked(spark, sf_dir)
    seg = segment.segments(b).select(
        "subject", "video", (F.col("start") / float(DAY)).alias("start"), (F.col("duration") / float(DAY)).alias("duration")
    )
    # Even stimuli report times relative to their own start, odd ones times of the recording.
    mixed = (
        _in_days(spark, sf_dir)
        .join(seg.select("subject", "video", F.col("start").alias("_s")), ["subject", "video"])
        .withColumn("end_s", F.when(F.col("video") % 2 == 0, F.col("end_s") - F.col("_s")).otherwise(F.col("end_s")))
        .drop("_s")
    )
    return segment.relative_axis(mixed, seg).select("subject", "video", "win", "relative", "axis_s")


@query(
    "src_union_by_name",
    final(
        SQL_SAMPLES,
        "SELECT subject, value AS valence, CAST(NULL AS DOUBLE) AS arousal FROM s WHERE channel = 'view' UNION ALL "
        "SELECT c_custkey, NULL, c_acctbal FROM customer",
        ["valence", "arousal"],
    ),
)
def union_rows(spark, sf_dir):
    s = samples(spark, sf_dir).where("channel = 'view'").select("subject", F.col("value").alias("valence"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_acctbal").alias("arousal"))
    return s.unionByName(c, allowMissingColumns=True)

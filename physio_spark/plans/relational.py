"""Queries: sources, projections, filters, joins and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from physio_spark.functions import labels as L
from physio_spark.functions.columns import clip_sigma, to_numeric
from physio_spark.operators import align, clean, project
from physio_spark.operators.signal import zscore
from physio_spark.plans.adapter import (
    SQL_ANNOTATIONS,
    SQL_SAMPLES,
    SQL_WINDOWS,
    STEP,
    annotations,
    samples,
    table,
    width_of,
    windowed,
)
from physio_spark.plans.registry import final, query

HOUR = 3_600_000_000
TICK = 3_700_000_000  # a coarse clock for half of the recordings
EPOCH_US = 1_704_067_200_000_000  # first instant of the recordings


@query(
    "src8_normalize_time",
    final(
        SQL_SAMPLES
        + f"""r AS (SELECT subject, event_id, CASE WHEN subject % 2 = 0 THEN (t - {EPOCH_US}) / {TICK}.0
                          ELSE (t - {EPOCH_US}) / 1e6 END AS raw FROM s),
              m AS (SELECT subject, max(raw) AS longest FROM r GROUP BY subject)""",
        "SELECT r.subject, event_id, CASE WHEN longest < 1e5 THEN raw * 1000.0 ELSE raw END AS time_ms "
        "FROM r JOIN m USING (subject)",
        ["time_ms"],
    ),
)
def src8(spark, sf_dir):
    s = samples(spark, sf_dir)
    rel = F.col("t") - F.lit(EPOCH_US)
    raw = F.when(F.col("subject") % 2 == 0, rel / float(TICK)).otherwise(rel / 1e6)
    out = clean.normalize_time(s.select("subject", "event_id", raw.alias("raw")), "raw")
    return out.select("subject", "event_id", "time_ms")


@query(
    "src9_to_numeric",
    final(
        "",
        "SELECT p_partkey, TRY_CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) AS brand_no, "
        "TRY_CAST(p_type AS DOUBLE) AS type_no, TRY_CAST(CASE WHEN p_size % 3 = 0 THEN 'n/a' "
        "ELSE CAST(p_size AS VARCHAR) END AS DOUBLE) AS size_no FROM part",
        ["brand_no", "type_no", "size_no"],
    ),
)
def src9(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size = F.when(F.col("p_size") % 3 == 0, "n/a").otherwise(F.col("p_size").cast("string"))
    return p.select(
        "p_partkey",
        to_numeric(F.replace("p_brand", F.lit("Brand#"), F.lit(""))).alias("brand_no"),
        to_numeric("p_type").alias("type_no"),
        to_numeric(size).alias("size_no"),
    )


LINE_META = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate")
PRICES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "prj1_feature_columns",
    final("", "SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem", PRICES),
)
def prj1(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(*project.feature_columns(li, LINE_META))


@query(
    "prj2_select_features",
    final(
        "",
        "SELECT l_suppkey, l_returnflag, l_tax, l_quantity, 'l_colour' AS missing FROM lineitem",
        ["l_tax", "l_quantity"],
    ),
)
def prj2(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    kept, missing = project.select_features(
        li, ["l_tax", "l_quantity", "l_colour"], meta=("l_suppkey", "l_returnflag")
    )
    return kept.withColumn("missing", F.lit(",".join(missing)))


@query(
    "prj4_coalesce_aliases",
    final(
        "",
        "SELECT l_orderkey, coalesce(CASE WHEN l_tax > 0.04 THEN l_tax END, CASE WHEN l_discount > 0.05 "
        "THEN l_discount END, l_quantity) AS rate FROM lineitem",
        ["rate"],
    ),
)
def prj4(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.when(F.col("l_tax") > 0.04, F.col("l_tax")).alias("rate_a"),
        F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("rate_b"),
        F.col("l_quantity").alias("rate_c"),
    )
    named = project.coalesce_aliases(li, {"rate": ["rate_x", "rate_a", "rate_b", "rate_c"]})
    return named.select("l_orderkey", "rate")


@query(
    "prj5_conform",
    final(
        "",
        "SELECT s_suppkey, CAST(NULL AS DOUBLE) AS bvp_sd1, s_acctbal, CAST(NULL AS VARCHAR) AS note FROM supplier",
        ["bvp_sd1", "s_acctbal"],
    ),
)
def prj5(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return project.conform(s, {"s_suppkey": "bigint", "bvp_sd1": "double", "s_acctbal": "double", "note": "string"})


@query(
    "flt1_exclude_videos",
    final(
        SQL_SAMPLES + "n AS (SELECT subject, event_id, CASE WHEN channel = 'error' THEN NULL ELSE video END AS video FROM s)",
        "SELECT subject, event_id, video FROM n WHERE video IS NULL OR video NOT IN (2, 5, 7)",
        longs=["video"],
    ),
)
def flt1(spark, sf_dir):
    s = samples(spark, sf_dir)
    holes = s.select("subject", "event_id", F.when(F.col("channel") != "error", F.col("video")).alias("video"))
    return project.exclude_videos(holes, ["2", "5", "7"])


@query("flt2_keep_classes", final("", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')"))
def flt2(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return project.keep_classes(o, ["1-URGENT", "5-LOW"], "o_orderpriority")


@query("flt3_keep_subjects", final(SQL_SAMPLES, "SELECT subject, event_id FROM s WHERE subject IN (3, 5, 8, 13, 21)"))
def flt3(spark, sf_dir):
    return project.keep_subjects(samples(spark, sf_dir).select("subject", "event_id"), [3, 5, 8, 13, 21])


@query(
    "flt4_exclude_labels",
    final("", "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) NOT IN ('household', 'machinery')"),
)
def flt4(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return project.exclude_labels(c, ["Household", "MACHINERY"], "c_mktsegment")


@query(
    "flt5_clip",
    final(
        SQL_SAMPLES + "m AS (SELECT subject, avg(value) AS mu, stddev_pop(value) AS sd FROM s GROUP BY subject)",
        "SELECT event_id, greatest(-2.0, least(2.0, CASE WHEN sd > 0 THEN (value - mu) / sd ELSE 0.0 END)) AS z "
        "FROM s JOIN m USING (subject)",
        ["z"],
    ),
)
def flt5(spark, sf_dir):
    z = zscore(samples(spark, sf_dir).select("subject", "event_id", "value"), ["value"], ["subject"])
    return z.select("event_id", clip_sigma("value_z", 2.0).alias("z"))


@query(
    "flt6_positive_only",
    final(
        "",
        "SELECT c_nationkey, count(*) FILTER (WHERE c_acctbal > 0) AS n, avg(c_acctbal) FILTER (WHERE c_acctbal > 0) AS mean, "
        "stddev_samp(c_acctbal) FILTER (WHERE c_acctbal > 0) AS std FROM customer GROUP BY c_nationkey",
        ["mean", "std"],
        ["c_nationkey"],
    ),
)
def flt6(spark, sf_dir):
    y = project.positive_only("c_acctbal")
    return (
        table(spark, sf_dir, "customer")
        .groupBy("c_nationkey")
        .agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"))
    )


# ---------------------------------------------------------------- joins

SQL_BRACKET = (
    SQL_SAMPLES
    + SQL_ANNOTATIONS
    + """
l AS (SELECT subject, t, event_id FROM s WHERE channel <> 'view'),
p AS (SELECT l.*, a.t AS bt, a.valence AS bv, a.arousal AS ba, a.video AS bid
      FROM l ASOF LEFT JOIN a ON l.subject = a.subject AND l.t >= a.t),
q AS (SELECT p.*, a.t AS ct, a.valence AS cv, a.arousal AS ca, a.video AS cid
      FROM p ASOF LEFT JOIN a ON p.subject = a.subject AND p.t <= a.t),
"""
)


def _lerp_sql(b: str, c: str) -> str:
    return (
        f"CASE WHEN bt IS NULL THEN {c} WHEN ct IS NULL OR ct = bt THEN {b} "
        f"ELSE {b} + (t - bt)::DOUBLE / (ct - bt)::DOUBLE * ({c} - {b}) END"
    )


def _sides(spark, sf_dir):
    s = samples(spark, sf_dir)
    left = s.where("channel <> 'view'").select("subject", "t", "event_id")
    return left, annotations(s), width_of(s)


@query(
    "jn1_interp_join",
    final(
        SQL_BRACKET,
        f"SELECT event_id, {_lerp_sql('bv', 'cv')} AS valence, {_lerp_sql('ba', 'ca')} AS arousal FROM q",
        ["valence", "arousal"],
    ),
)
def jn1(spark, sf_dir):
    left, ann, width = _sides(spark, sf_dir)
    return align.interp_join(left, ann, width=width).select("event_id", "valence", "arousal")


@query(
    "jn2_nearest_id",
    final(
        SQL_BRACKET,
        "SELECT event_id, CASE WHEN bt IS NULL THEN cid WHEN ct IS NULL THEN bid WHEN ct - t < t - bt THEN cid "
        "ELSE bid END AS nearest, CAST(round_even("
        + _lerp_sql("bid", "cid")
        + ", 0) AS BIGINT) AS rounded FROM q",
        longs=["nearest", "rounded"],
    ),
)
def jn2(spark, sf_dir):
    left, ann, width = _sides(spark, sf_dir)
    both = ann.select("subject", "t", F.col("video").alias("nearest"), F.col("video").alias("rounded"))
    near = align.interp_join(left, both, cols=[], round_cols=["nearest"], width=width)
    compat = align.interp_join(near, both, cols=[], round_cols=["rounded"], round_mode="compat", width=width)
    return compat.select("event_id", "nearest", "rounded")


SHIFT = 6 * HOUR


@query(
    "jn3_shift_labels",
    final(
        SQL_SAMPLES
        + f"""v AS (SELECT subject, t, event_id, value AS valence FROM s),
              p AS (SELECT subject, t + {SHIFT} AS goal, event_id FROM s)""",
        "SELECT p.event_id, v.valence FROM p ASOF JOIN v ON p.subject = v.subject AND p.goal <= v.t",
        ["valence"],
    ),
)
def jn3(spark, sf_dir):
    s = samples(spark, sf_dir).select("subject", "t", "event_id", F.col("value").alias("valence"))
    shifted = align.shift_labels(s, SHIFT, cols=["valence"], width=width_of(s))
    return shifted.select("event_id", "valence")


@query(
    "jn4_interval_agg",
    final(
        SQL_WINDOWS
        + SQL_ANNOTATIONS
        + """h AS (SELECT w.subject, w.win_start, w.win_end, a.valence, a.arousal, a.video
                   FROM w JOIN a ON a.subject = w.subject AND a.t BETWEEN w.win_start AND w.win_end),
             g AS (SELECT subject, win_start, win_end, avg(valence) AS valence, avg(arousal) AS arousal, count(*) AS n
                   FROM h GROUP BY ALL),
             m AS (SELECT subject, win_start, win_end, video FROM h GROUP BY subject, win_start, win_end, video
                   QUALIFY row_number() OVER (PARTITION BY subject, win_start, win_end ORDER BY count(*) DESC, video) = 1)""",
        "SELECT w.subject, w.win_start, w.win_end, g.valence, g.arousal, coalesce(g.n, 0) AS n_points, m.video AS video_mode "
        "FROM (SELECT DISTINCT subject, win_start, win_end FROM x) w LEFT JOIN g USING (subject, win_start, win_end) LEFT JOIN m USING (subject, win_start, win_end)",
        ["valence", "arousal"],
        ["video_mode"],
    ),
)
def jn4(spark, sf_dir):
    wd, width = windowed(spark, sf_dir)
    windows = wd.select("subject", "win_start", "win_end").distinct()
    points = annotations(samples(spark, sf_dir))
    out = align.interval_agg(windows, points, start="win_start", end="win_end", mode="video", width=min(width, STEP))
    return out.select("subject", "win_start", "win_end", "valence", "arousal", "n_points", "video_mode")


SQL_CLASS_MAP = "m(video, label) AS (VALUES (1, 'amused'), (2, 'amused'), (3, 'bored'), (4, 'bored'), (5, 'relaxed'), (6, 'relaxed'), (7, 'scary'))"
CLASS_MAP = {k: v for k, v in L.VIDEO_CLASS.items() if k != 8}


@query(
    "jn5_map_labels",
    final(SQL_SAMPLES + SQL_CLASS_MAP, "SELECT event_id, s.video, label FROM s JOIN m ON s.video = m.video", longs=["video"]),
)
def jn5(spark, sf_dir):
    return align.map_labels(samples(spark, sf_dir).select("event_id", "video"), CLASS_MAP)


@query(
    "jn5_unmapped",
    final(SQL_SAMPLES + SQL_CLASS_MAP, "SELECT video, count(*) AS n FROM s WHERE video NOT IN (SELECT video FROM m) GROUP BY video", longs=["video"]),
)
def jn5_report(spark, sf_dir):
    return align.unmapped(samples(spark, sf_dir), CLASS_MAP)


@query(
    "jn6_assemble",
    final(
        SQL_SAMPLES,
        "SELECT subject, video, min(t) AS first_t, avg(value) AS label_mean, max(value) AS feature_max FROM s GROUP BY ALL",
        ["label_mean", "feature_max"],
        ["video"],
    ),
)
def jn6(spark, sf_dir):
    g = samples(spark, sf_dir).groupBy("subject", "video")
    return align.assemble(
        g.agg(F.min("t").alias("first_t")),
        g.agg(F.avg("value").alias("label_mean")),
        g.agg(F.max("value").alias("feature_max")),
        ["subject", "video"],
    )


@query(
    "jn7_semi_join",
    final(
        SQL_SAMPLES,
        "SELECT subject, event_id FROM s WHERE subject IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')",
    ),
)
def jn7(spark, sf_dir):
    chosen = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey")
    return project.keep_subjects(samples(spark, sf_dir).select("subject", "event_id"), chosen)


@query(
    "jn7_anti_join",
    final(
        SQL_SAMPLES,
        "SELECT subject, event_id FROM s WHERE subject NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')",
    ),
)
def jn7_anti(spark, sf_dir):
    chosen = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey")
    return project.drop_subjects(samples(spark, sf_dir).select("subject", "event_id"), chosen)


# ---------------------------------------------------------------- labels

SQL_VA = """
CASE WHEN v IS NULL OR a IS NULL OR (v BETWEEN 4 AND 6 AND a BETWEEN 4 AND 6) THEN 'neutral'
     WHEN v < 4 AND a > 6 THEN 'scary' WHEN v < 4 AND a < 4 THEN 'bored'
     WHEN v > 6 AND a > 6 THEN 'amused' WHEN v > 6 AND a < 4 THEN 'relaxed'
     WHEN v > 6 THEN CASE WHEN a >= 5 THEN 'amused' ELSE 'relaxed' END
     WHEN v < 4 THEN CASE WHEN a >= 5 THEN 'scary' ELSE 'bored' END
     WHEN a > 6 THEN CASE WHEN v >= 5 THEN 'amused' ELSE 'scary' END
     ELSE CASE WHEN v >= 5 THEN 'relaxed' ELSE 'bored' END END
"""
SQL_RATINGS = """
r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity / 5 END AS v, l_discount * 100 AS a
      FROM lineitem)
"""


def _ratings(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity") / 5).alias("v"),
        (F.col("l_discount") * 100).alias("a"),
    )


@query(
    "lab1_va_label",
    final(SQL_RATINGS, f"SELECT l_orderkey, l_linenumber, {SQL_VA} AS label FROM r", longs=["l_linenumber"]),
)
def lab1(spark, sf_dir):
    return _ratings(spark, sf_dir).select("l_orderkey", "l_linenumber", L.va_label("v", "a").alias("label"))


@query(
    "lab2_merge_labels",
    final(
        SQL_RATINGS + f", x AS (SELECT {SQL_VA} AS label FROM r)",
        "SELECT CASE WHEN label = 'neutral' THEN 'bored' ELSE label END AS label, count(*) AS n FROM x GROUP BY 1",
    ),
)
def lab2(spark, sf_dir):
    labelled = _ratings(spark, sf_dir).select(L.va_label("v", "a").alias("label"))
    return L.merge_labels(labelled, {"neutral": "bored"}).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "lab3_category_of",
    final(
        "",
        "SELECT p_partkey, array_to_string(list_slice(string_split(p_name, ' '), 1, greatest(1, len(string_split(p_name, ' ')) - 1)), ' ') AS category, "
        "CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) AS variant FROM part",
    ),
)
def lab3(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", L.category_of("p_name").alias("category"), L.variant_of("p_brand").alias("variant"))


@query(
    "lab4_binary_experiment",
    final(
        SQL_SAMPLES
        + "m(video, label) AS (VALUES (1, 'amused'), (2, 'amused'), (3, 'bored'), (4, 'bored'), (5, 'relaxed'), (6, 'relaxed'), (7, 'scary'), (8, 'scary')),"
        + "e(pos, neg) AS (VALUES ('scary', 'amused'), ('bored', 'relaxed'), ('scary', 'bored'), ('amused', 'bored'))",
        "SELECT pos || '_vs_' || neg AS experiment, CASE WHEN label = pos THEN 1 ELSE 0 END AS target, count(*) AS n "
        "FROM s JOIN m USING (video) JOIN e ON label IN (pos, neg) GROUP BY ALL",
        longs=["target"],
    ),
)
def lab4(spark, sf_dir):
    labelled = align.map_labels(samples(spark, sf_dir).select("video"), L.VIDEO_CLASS)
    parts = [
        frame.groupBy("target").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("experiment"), "target", "n")
        for name, frame in L.experiments(labelled).items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out



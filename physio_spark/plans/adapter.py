"""The supplied tables in the roles of the data model, once for Spark and once as SQL.

``events`` are the recordings: a user is a subject, the time stamp in microseconds is the sample
time, and the stimulus id (1..8) is the four-day period.  Signals are sparse there, so windows are
counted in days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from physio_spark.operators.ordered import chunk_width
from physio_spark.operators.segment import blocks
from physio_spark.operators.stats import with_neighbours
from physio_spark.operators.windows import time_windows

DAY = 86_400_000_000
LENGTH, STEP = 2 * DAY, DAY
SCAN_WIDTH = 4 * DAY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.col("user_id").alias("subject"),
        F.unix_micros(ts).alias("t"),
        (1 + F.floor((F.dayofmonth("ts") - 1) / 4)).cast("int").alias("video"),
        F.col("event_type").alias("channel"),
        "value",
        "event_id",
    )


def width_of(df: DataFrame, by=("subject",)) -> int:
    return chunk_width(df, list(by), "t", SCAN_WIDTH)


def annotations(s: DataFrame) -> DataFrame:
    return s.where("channel = 'view'").select(
        "subject", "t", F.col("value").alias("valence"), F.sqrt("value").alias("arousal"), "video"
    )


def blocked(spark: SparkSession, sf_dir: str, key: str = "video") -> tuple[DataFrame, int]:
    s = samples(spark, sf_dir)
    width = width_of(s)
    return blocks(s, key=key, width=width), width


def windowed(spark: SparkSession, sf_dir: str, neighbours: bool = False) -> tuple[DataFrame, int]:
    """Two-day windows every day inside the stimulus blocks."""
    b, width = blocked(spark, sf_dir)
    if neighbours:
        b = with_neighbours(b, ["subject", "block"], ["value"], width=width)
    return time_windows(b, LENGTH, STEP), width


def orders_as_predictions(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Orders in the role of scored windows; one class is never predicted.  ``more`` columns of the orders on request."""
    o = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    guess = (
        F.when(price < 100000, "1-URGENT")
        .when(price < 200000, "2-HIGH")
        .when(price < 300000, "3-MEDIUM")
        .otherwise("5-LOW")
    )
    return o.select(
        F.col("o_custkey").alias("subject"),
        (1 + F.pmod(F.col("o_orderkey"), F.lit(4))).alias("video"),
        F.col("o_orderkey").alias("position"),
        (1 + F.pmod(F.col("o_custkey"), F.lit(5))).alias("fold"),
        F.col("o_orderpriority").alias("true_label"),
        guess.alias("pred_label"),
        *[
            (F.pmod(F.col("o_orderkey") * m, F.lit(9)) / 8.0).alias(f"proba_{c}")
            for c, m in (("amused", 1), ("bored", 2), ("scary", 5))
        ],
        *more,
    )


# ---------------------------------------------------------------- SQL counterparts

SQL_SAMPLES = """
s AS (SELECT user_id AS subject, epoch_us(ts) AS t,
             1 + CAST(floor((day(ts) - 1) / 4.0) AS INTEGER) AS video,
             event_type AS channel, value, event_id FROM events),
"""
SQL_ANNOTATIONS = """
a AS (SELECT subject, t, value AS valence, sqrt(value) AS arousal, video FROM s WHERE channel = 'view'),
"""


def sql_blocks(key: str = "video") -> str:
    return f"""
b0 AS (SELECT *, lag({key}) OVER (PARTITION BY subject ORDER BY t) AS before_key FROM s),
b1 AS (SELECT *, sum(CASE WHEN before_key IS NULL OR before_key <> {key} THEN 1 ELSE 0 END)
                 OVER (PARTITION BY subject ORDER BY t) AS block FROM b0),
seg AS (SELECT subject, block, {key}, min(t) AS t0, max(t) AS t1, count(*) AS n FROM b1 GROUP BY ALL),
"""


SQL_WINDOWS = (
    SQL_SAMPLES
    + sql_blocks()
    + f"""
w AS (SELECT *, t0 + win * {STEP} AS win_start, t0 + win * {STEP} + {LENGTH} AS win_end
      FROM (SELECT subject, block, video, t0, unnest(range(0, (t1 - t0 - {LENGTH}) // {STEP} + 1)) AS win
            FROM seg WHERE t1 - t0 >= {LENGTH})),
x AS (SELECT w.subject, w.block, w.video, w.win, w.win_start, w.win_end, b1.t, b1.value, b1.channel, b1.event_id,
             lag(b1.value) OVER v AS before, lead(b1.value) OVER v AS after, row_number() OVER v AS idx
      FROM w JOIN b1 ON b1.subject = w.subject AND b1.block = w.block AND b1.t >= w.win_start AND b1.t < w.win_end
      WINDOW v AS (PARTITION BY w.subject, w.block, w.win ORDER BY b1.t)),
"""
)

SQL_PREDICTIONS = """
p AS (SELECT o_custkey AS subject, 1 + o_orderkey % 4 AS video, o_orderkey AS position,
             1 + o_custkey % 5 AS fold, o_orderpriority AS true_label,
             CASE WHEN o_totalprice < 100000 THEN '1-URGENT' WHEN o_totalprice < 200000 THEN '2-HIGH'
                  WHEN o_totalprice < 300000 THEN '3-MEDIUM' ELSE '5-LOW' END AS pred_label,
             (o_orderkey % 9) / 8.0::DOUBLE AS proba_amused, ((o_orderkey * 2) % 9) / 8.0::DOUBLE AS proba_bored,
             ((o_orderkey * 5) % 9) / 8.0::DOUBLE AS proba_scary
      FROM orders),
"""

"""Queries: given tables written through the sinks and read back through the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from physio_spark.operators import project
from physio_spark.plans.adapter import SQL_SAMPLES, samples, table
from physio_spark.plans.registry import final, query
from physio_spark.runtime import checkpoint_dir
from physio_spark.sources import readers, writers


def _folder(spark: SparkSession) -> str:
    """A fresh shared folder."""
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def _recordings(spark: SparkSession, sf_dir: str, broken: bool = False) -> str:
    """A folder of recordings, some files for each subject, on request with lines that no reader should take."""
    s = samples(spark, sf_dir)
    ms = F.format_string("%d.%03d", F.floor(F.col("t") / 1000), F.col("t") % 1000)
    fields = [ms, F.col("value").cast("string"), F.col("video").cast("string")]
    lines = s.select("subject", "t", F.concat_ws(",", *fields).alias("line"))
    if broken:
        odd = s.where(F.col("event_id") % 7 == 0)
        long = odd.select("subject", "t", F.concat_ws(",", *fields, F.lit("9"), F.lit("9")).alias("line"))
        text = odd.select("subject", F.col("t") + 1, F.concat_ws(",", ms, F.lit("oops"), fields[2]).alias("line"))
        short = odd.select("subject", F.col("t") + 2, ms.alias("line"))
        lines = lines.union(long).union(text).union(short)
    folder = _folder(spark)
    named = lines.withColumn("file", F.concat(F.lit("sub_"), "subject"))
    writers.write_lines(named.drop("subject"), folder, "file", "line", "daqtime,ECG,video", ["t"], spread=2)
    return folder


@query(
    "src1_read_samples",
    final(SQL_SAMPLES, "SELECT subject, t, t / 1000.0::DOUBLE / 1000 AS time_s, video, value AS ecg FROM s", ["time_s", "ecg"], ["video"]),
)
def src1(spark, sf_dir):
    return readers.read_samples(spark, _recordings(spark, sf_dir)).select("subject", "t", "time_s", "video", "ecg")


@query(
    "src2_tolerant_scan",
    final(
        SQL_SAMPLES,
        "SELECT subject, count(*) + 2 * count(*) FILTER (WHERE event_id % 7 = 0) AS n, count(*) AS n_ecg, sum(value) AS ecg FROM s GROUP BY subject",
        ["ecg"],
    ),
)
def src2(spark, sf_dir):
    """Lines with too many fields go, words for numbers and missing fields become nulls."""
    read = readers.read_samples(spark, _recordings(spark, sf_dir, broken=True), bad_lines="skip")
    return read.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.count("ecg").alias("n_ecg"), F.sum("ecg").alias("ecg"))


@query(
    "src3_read_annotations",
    final(SQL_SAMPLES, "SELECT subject, (t // 1000) * 1000 AS t, value AS valence, sqrt(value) AS arousal FROM s WHERE channel = 'view' AND subject % 3 = 1", ["valence", "arousal"]),
)
def src3(spark, sf_dir):
    """Headers in an order of their own, subjects from a list."""
    s = samples(spark, sf_dir).where("channel = 'view'")
    line = F.concat_ws(",", F.sqrt("value").cast("string"), F.floor(F.col("t") / 1000).cast("string"), F.col("value").cast("string"))
    named = s.select("t", line.alias("line"), F.concat(F.lit("sub_"), "subject").alias("file"))
    folder = _folder(spark)
    writers.write_lines(named, folder, "file", "line", "arousal,jstime,valence", ["t"])
    wanted = [r["subject"] for r in s.select("subject").distinct().where("subject % 3 = 1").collect()]
    return readers.read_annotations(spark, folder, wanted).select("subject", "t", "valence", "arousal")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("start_s"), F.col("o_orderpriority").alias("label_valence"),
        F.col("o_totalprice").alias("price_mean"), F.length("o_orderstatus").alias("status_n"),
    )


SQL_FEATURES = "SELECT o_custkey AS subject, o_orderkey AS start_s, o_orderpriority AS label_valence, o_totalprice AS price_mean, length(o_orderstatus) AS status_n FROM orders"


@query("src4_read_features", final("", SQL_FEATURES, ["price_mean"], ["status_n"]))
def src4(spark, sf_dir):
    """Compressed CSV by its suffix, back through the reader."""
    out = _folder(spark)
    d = _features(spark, sf_dir)
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in d.columns])
    writers.write_lines(d.select("*", line.alias("line"), F.lit("features").alias("file")), out, "file", "line", ",".join(d.columns), ["start_s"], spread=8)
    return readers.read_features(spark, f"{out}/*.csv").select(*[F.col(c).cast(d.schema[c].dataType).alias(c) for c in d.columns])


@query("snk1_write_features", final("", SQL_FEATURES, ["price_mean"], ["status_n"]))
def snk1(spark, sf_dir):
    """Features, labels and meta data in tables of their own, put together again by their row."""
    out = _folder(spark)
    d = _features(spark, sf_dir)
    writers.write_features(d, out, labels=["label_valence"])
    x, y, meta = (readers.read_features(spark, f"{out}/{name}") for name in ("X", "y_label_valence", "meta"))
    return meta.join(x, "row").join(y, "row").select(*d.columns)


@query(
    "src5_read_videos",
    "SELECT p_name || ' ' || p_partkey AS video_name, round(CAST(p_retailprice AS DOUBLE), 6) + 0.0 AS video_duration FROM part",
)
def src5(spark, sf_dir):
    """Quoted names, tabs, and a trailing tab on every third line."""
    p = table(spark, sf_dir, "part")
    name = F.concat(F.lit('"'), "p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.lit('"'))
    line = F.concat(name, F.lit("\t"), F.col("p_retailprice").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "\t").otherwise(""))
    folder = _folder(spark)
    writers.write_lines(p.select("p_partkey", line.alias("line"), F.lit("videos").alias("file")), folder, "file", "line", '"video_name"\t"video_duration"', spread=4)
    return readers.read_videos(spark, folder)


@query(
    "snk2_write_metrics",
    final("", "SELECT o_orderpriority AS label, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, avg(o_totalprice) AS price FROM orders GROUP BY ALL", ["price"]),
)
def snk2(spark, sf_dir):
    """A nested report as JSON lines and back."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "label")
    counts = F.struct(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    report = o.groupBy("label").agg(counts.alias("counts"), F.avg("o_totalprice").alias("price"))
    folder = _folder(spark)
    writers.write_metrics({"report": report}, folder)
    return spark.read.schema(report.schema).json(f"{folder}/report_json").select("label", "counts.*", "price")


CHANNELS = ["ecg", "bvp", "gsr", "emg_zygo"]


@query(
    "prj3_channel_sets",
    final(
        "",
        "SELECT vec_id, name, unnest(range(0, len(x) // 16)) AS place, list_sum(x[place * 16 + 1 : place * 16 + 16]) AS total FROM "
        "(SELECT vec_id, unnest(['all_channels', 'no_emg', 'eda_only', 'ecg_only', 'no_gsr', 'no_ecg', 'combined', 'face']) AS name, "
        "list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e, CASE name WHEN 'all_channels' THEN e WHEN 'no_emg' THEN e[1:48] WHEN 'eda_only' THEN e[33:48] WHEN 'ecg_only' THEN e[1:16] "
        "WHEN 'no_gsr' THEN list_concat(e[1:32], e[49:64]) WHEN 'no_ecg' THEN e[17:64] WHEN 'combined' THEN list_concat(e[1:16], e[33:48]) ELSE e[49:64] END AS x FROM embeddings)",
        ["total"],
    ),
)
def prj3(spark, sf_dir):
    """Every named set of four channels, as sums of each channel that it keeps."""
    e = table(spark, sf_dir, "embeddings")
    x = e.select("vec_id", F.array(*[F.slice("embedding", 16 * i + 1, 16) for i in range(4)]).alias("x"))
    parts = []
    for name, wanted in project.channel_sets(CHANNELS).items():
        kept = project.select_channels(x, CHANNELS, wanted).select("vec_id", F.lit(name).alias("name"), F.posexplode("x").alias("place", "own"))
        total = F.aggregate("own", F.lit(0.0), lambda a, v: a + v.cast("double"))
        parts.append(kept.select("vec_id", "name", "place", total.alias("total")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS], after one warm-up run.

Prints one JSON line.  Every query runs over its whole tables; the result is written to the no-op
sink, so all columns of all rows are computed.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from physio_spark.plans import load_queries

HEADLINE = (
    "win3_time_windows",
    "win1_blocks",
    "win5_count_windows",
    "win10_normalize_curve",
    "jn1_interp_join",
    "jn3_shift_labels",
    "jn4_interval_agg",
    "agg2_extended_stats",
    "agg7_difference_stats",
    "agg15_category_summary",
    "agg22_describe",
    "sig1_rolling_mean",
    "sig6_peaks",
    "sig12_band_peak",
    "cln7_downsample_median",
    "ml1_group_kfold",
    "ml4_oof_forest",
    "evl4_classification_report",
    "evl8_running_vote",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_queries()
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):  # the first run warms up code generation
            begin = time.perf_counter()
            registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

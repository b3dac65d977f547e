"""Sinks for feature tables and evaluation results."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from physio_spark.operators.project import META_COLUMNS, feature_columns
from physio_spark.runtime import materialize


def write_features(
    df: DataFrame,
    out: str,
    labels: Sequence[str] = ("label_valence", "label_arousal"),
    csv: bool = True,
    partition_by: str | None = None,
    mode: str = "overwrite",
) -> None:
    """Write features, labels, window meta data and the combined table.

    The rows are computed once; every table names them in a column ``row``, by which the tables can be joined
    again (the frame must not have a column of that name).  ``combined`` is partitioned by ``partition_by`` (for instance the subject) when given; with
    ``csv`` every table is also written as gzip-compressed CSV.
    """
    if "row" in (c.lower() for c in df.columns):
        raise ValueError("the tables have a column 'row' of their own")
    features = feature_columns(df)
    numbered = materialize(df.select(F.monotonically_increasing_id().alias("row"), "*"))
    meta = [c for c in df.columns if c in META_COLUMNS and c not in labels]
    present = [c for c in labels if c in df.columns]
    tables = {
        "X": numbered.select("row", *features),
        "meta": numbered.select("row", *meta),
        "combined": numbered,
        **{f"y_{c}": numbered.select("row", c) for c in present},
    }
    for name, table in tables.items():
        writer = table.write.mode(mode)
        if name == "combined" and partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(f"{out}/{name}")
        if csv:
            table.write.mode(mode).option("header", True).option("compression", "gzip").csv(f"{out}/{name}_csv")


def write_metrics(tables: dict[str, DataFrame], out: str, mode: str = "overwrite") -> None:
    """Write small result frames as CSV and as JSON lines (nested columns only as JSON)."""
    for name, table in tables.items():
        one = materialize(table).repartition(1)  # the result is small, the work behind it is not
        one.write.mode(mode).json(f"{out}/{name}_json")
        flat = [
            F.to_json(c).alias(c) if kind.startswith(("map", "struct", "array")) else F.col(c)
            for c, kind in table.dtypes
        ]
        one.select(*flat).write.mode(mode).option("header", True).csv(f"{out}/{name}_csv")


def write_lines(df: DataFrame, folder: str, name: str, line: str, header: str = "", order: Sequence[str] = (), spread: int = 1) -> DataFrame:
    """Text files named by a column: ``part-<n>-<name>.csv``, each with a header; returns their paths.

    The rows of a name are dealt to ``spread`` files, in ``order`` within each; a task streams its rows and holds
    one file open.  Only files that a finished task reports belong to the result.
    """
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*[c for c, _ in df.dtypes]), F.lit(spread)).cast("int"))
    dealt = dealt.repartition(name, "_part").sortWithinPartitions(name, "_part", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        stream, now, done = None, None, []
        for batch in batches:
            for key, part, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, part) != now:
                    if stream is not None:
                        stream.close()
                    now = (key, part)
                    done.append(f"{root}/part-{attempt}-{part}-{key}.csv")
                    stream = system.open_output_stream(done[-1], compression=None, buffer_size=1 << 16)
                    stream.write(f"{header}\n".encode() if header else b"")
                stream.write(f"{text}\n".encode())
        if stream is not None:
            stream.close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["path"])

    return materialize(dealt.select(F.col(name).cast("string"), "_part", F.col(line).cast("string")).mapInArrow(run, "path string"))

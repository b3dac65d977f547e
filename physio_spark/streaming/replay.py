"""A live table in a folder: rows arrive in parts, a stream works on what is new, its results are a table.

Everything lies in one shared folder: ``in`` (arrived rows), ``state`` (the stream's checkpoint) and ``out``
(results, each exactly once).  A run ends when it has worked on all that arrived; the next one, in this session or
another, goes on from the checkpoint.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from physio_spark.runtime import checkpoint_dir


class LiveTable:
    """``arrive`` adds rows, ``advance`` runs ``build`` over what has arrived, ``results`` reads what it wrote."""

    def __init__(self, spark: SparkSession, build: Callable[[DataFrame], DataFrame], folder: str | None = None) -> None:
        self.spark, self.build = spark, build
        self.folder = folder or f"{checkpoint_dir(spark)}/live-{uuid.uuid4().hex}"
        self.schema = None

    def arrive(self, rows: DataFrame) -> None:
        self.schema = rows.schema
        rows.write.mode("append").parquet(f"{self.folder}/in")

    def advance(self) -> int:
        """Work on all new rows; the number that came too late, behind the watermark, and were dropped.

        Spark counts them where it keeps state: rows that a task has summed up before count as one.
        """
        stream = self.build(self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in"))
        self.result = stream.schema
        writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{self.folder}/state")
        query = writer.trigger(availableNow=True).start(f"{self.folder}/out")
        query.awaitTermination()
        return sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)

    def results(self) -> DataFrame:
        return self.spark.read.schema(self.result).parquet(f"{self.folder}/out")


def replay(rows: DataFrame, ts: str, build: Callable[[DataFrame], DataFrame], after: str) -> DataFrame:
    """The results of a stream over a finished table that arrives in two parts, the earlier half of its time first.

    The stream is stopped between the parts and started again from its checkpoint.  At the end a row
    without any value but a time ``after`` later (an interval) than the last one closes all that is still open.
    Rows without a time are not part of a stream.
    """
    live = LiveTable(rows.sparkSession, build)
    rows = rows.where(F.col(ts).isNotNull())
    span = rows.agg(F.min(ts).cast("timestamp").cast("double").alias("a"), F.max(ts).cast("timestamp").cast("double").alias("b")).first()
    early = F.col(ts).cast("timestamp").cast("double") < F.lit(((span["a"] or 0.0) + (span["b"] or 0.0)) / 2)
    late = 0
    for part in (rows.where(early), rows.where(~early)):
        live.arrive(part)
        late += live.advance()
    end = rows.agg((F.max(ts) + F.expr(f"INTERVAL {after}")).alias(ts))
    live.arrive(end.select(*[F.col(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]))
    late += live.advance()
    if late:
        raise ValueError(f"{late} rows came behind the watermark")
    return live.results()

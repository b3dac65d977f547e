"""Session settings and lineage cutting shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest number of rows one task is asked to hold in order (see operators.ordered).
ROWS_PER_CHUNK = 1_000_000

# Compressed bytes that adaptive execution gives a task of a shuffle (Spark's default is 64 MB).  The sorts of a
# scan up, a scan down and a join hold several times that at once, uncompressed.
TASK_BYTES = "8m"

_local_scratch: str | None = None


def prepare(spark: SparkSession, task_bytes: str = TASK_BYTES) -> SparkSession:
    """Set the SQL options the operators rely on; all are runtime options of a live session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", task_bytes)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent, a scratch folder serves local sessions (tests); a cluster is refused
    one, since a machine-local folder would not survive the loss of an executor.
    """
    global _local_scratch
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="physio-scratch-")
    return _local_scratch


def materialize(df: DataFrame, by: Sequence[str] = (), rows: int = 0) -> DataFrame:
    """Cut the lineage of a frame that several later stages read.

    The rows are computed once and written as a Parquet table to the shared folder, so later readers
    prune columns and push filters, and lost executors cost nothing but the tasks they ran.  With ``by``
    the table has a folder for each value, and a filter on it opens no other; its files are of the size that
    adaptive execution advises.  ``rows`` bounds the rows of a file (0: no bound): a file of one row group is
    read by one task, so a table that many passes read needs more than one.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    writer = df.hint("rebalance", *map(F.col, by)).write.partitionBy(*by) if by else df.write
    writer.option("maxRecordsPerFile", rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


# Independent jobs submitted at a time: short fits leave cores idle between their stages.
JOBS_AT_ONCE = 8


def concurrently(spark: SparkSession, calls: Sequence[Callable[[], object]], width: int | None = None) -> list:
    """Results of independent driver-side calls, in order; each submits its jobs in a scheduler pool of its own.

    The pools share the executors evenly where the session runs with ``spark.scheduler.mode=FAIR``.  The first
    failure is raised after the calls that had begun.
    """

    def in_pool(call: Callable[[], object]):
        def run():
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"concurrent-{uuid.uuid4().hex[:8]}")
            return call()

        return inheritable_thread_target(spark)(run)

    with ThreadPoolExecutor(width or JOBS_AT_ONCE) as pool:
        futures = [pool.submit(in_pool(call)) for call in calls]
        try:
            return [f.result() for f in futures]
        except BaseException:
            for f in futures:
                f.cancel()
            raise

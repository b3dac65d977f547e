"""Approximate nearest neighbours by cross-polytope hashing.

A table rotates unit vectors by three rounds of random signs and a fast Hadamard transform and files them
under the nearest signed axis.  A query looks under the nearest few axes of every table.  What it meets is
scored exactly, by cosine in double precision on the original vectors.

Equal vectors are one entry with its smallest ids, so that copies neither fill a bucket nor crowd each
other out.  Buckets are cut into blocks of bounded size for data and queries alike; every pair of
blocks answers with the best few of each query only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .common import refuse

DATA_BLOCK = 512
QUERY_BLOCK = 64


def _rotate(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Pseudo-rotation of the rows: three times signs and Hadamard, over the next power of two of dimensions."""
    size = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = x
    signs = np.random.default_rng([seed, table]).choice(np.array([-1.0, 1.0]), (3, size))
    for row in signs:
        y *= row
        width = 1
        while width < size:
            pairs = y.reshape(len(y), -1, 2, width)
            y = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(len(y), size)
            width *= 2
    return y


def axes(x: np.ndarray, table: int, probes: int, seed: int) -> np.ndarray:
    """The ``probes`` nearest signed axes of each row, nearest first; axis k is 2k + 1 on its positive side."""
    y = _rotate(x, table, seed)
    signed = np.stack([-y, y], axis=2).reshape(len(y), -1)
    return np.argsort(-signed, axis=1, kind="stable")[:, :probes]


def _usable(vector: Column, dims: int) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & (F.size(vector) == dims) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def _stack(column: pa.Array, dims: int) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(array), dims)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of large or tiny components stay in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def search(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, tables: int = 10, probes: int = 12, seed: int = 11) -> DataFrame:
    """``query_id, rank, <key>, score``: of each query row the ``k`` nearest other rows that the tables hold.

    Nearness is the cosine; equal scores go to the smaller key.  Vectors that are null, zero, of another
    length than the first usable one, or that hold null or non-finite components take no part, nor do rows
    with a null key.  A query's own key never answers it; one that repeats with other vectors asks with each.
    A query with fewer than ``k`` candidates gets those that there are.
    """
    refuse(key, "query_id", "rank", "score")
    kind = "float" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"), is_query.alias("q")).where("id IS NOT NULL")
    first = rows.where(F.size("v") > 0).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if first is None:
        return vectors.sparkSession.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    dims = first["n"]
    spread = 2 * (1 << max(1, (dims - 1).bit_length()))
    good = rows.where(_usable(F.col("v"), dims)).withColumn("v", F.transform("v", lambda x: x + F.lit(0).cast(kind)))  # -0.0 becomes 0.0
    few = lambda l: F.slice(F.array_sort(F.array_distinct(l)), 1, k + 1)
    salted = good.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).agg(few(F.collect_list("id")).alias("ids"), F.max("q").alias("q"))
    whole = salted.groupBy("v").agg(few(F.flatten(F.collect_list("ids"))).alias("ids"), F.max("q").alias("q"))
    entries = materialize(whole.select(F.monotonically_increasing_id().alias("mark"), F.col("ids")[0].alias("least"), "v", "ids", "q"))
    queries = entries.where("q").select("mark", "least", "v")

    def hashed(frame: DataFrame, n: int) -> DataFrame:
        """One row for each table and axis of every row; the vector goes along."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                x = _unit(_stack(batch.column(2), dims))
                for t in range(tables):
                    found = axes(x, t, n, seed)
                    take = pa.array(np.repeat(np.arange(len(x)), found.shape[1]))
                    home = pa.array((found + t * spread).ravel().astype(np.int64))
                    yield pa.RecordBatch.from_arrays([home, *(c.take(take) for c in batch.columns)], ["bucket", "mark", "least", "v"])

        return frame.mapInArrow(run, f"bucket long, mark long, least long, v array<{kind}>")

    def blocks(frame: DataFrame, n: int, most: int, prefix: str) -> DataFrame:
        """Packed blocks of about ``most`` rows; there are 2 x dims x tables buckets whatever the data."""
        filed = materialize(hashed(frame, n))
        sizes = filed.groupBy("bucket").agg(F.count("*").alias("n"))
        cut = F.pmod(F.xxhash64("mark"), F.ceil(F.col("n") / most))
        packed = filed.join(F.broadcast(sizes), "bucket").groupBy("bucket", cut.alias("cut")).agg(F.collect_list(F.struct("mark", "least", "v")).alias("l"))
        return packed.select("bucket", F.col("l.mark").alias(f"{prefix}m"), F.col("l.least").alias(f"{prefix}l"), F.flatten("l.v").alias(f"{prefix}v"))

    pairs = blocks(queries, probes, QUERY_BLOCK, "a").join(blocks(entries.select("mark", "least", "v"), 1, DATA_BLOCK, "b"), "bucket")
    keep = k + 1

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for am, av, bm, bl, bv in zip(*batch.columns, strict=True):
                least = bl.values.to_numpy()
                order = np.argsort(least, kind="stable")  # of equals the smaller key comes first
                x, y = (_unit(v.values.to_numpy().astype(np.float64).reshape(-1, dims)) for v in (av, bv))
                near = np.round(x @ y[order].T, 12)
                top = np.argsort(-near, axis=1, kind="stable")[:, :keep]
                found = np.take_along_axis(near, top, axis=1)
                out.append((np.repeat(am.values.to_numpy(), top.shape[1]), bm.values.to_numpy()[order][top].ravel(), least[order][top].ravel(), -found.ravel()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(4)], ["a", "b", "least", "s"])

    met = pairs.select("am", "av", "bm", "bl", "bv").mapInArrow(score, "a long, b long, least long, s double")
    best = met.groupBy("a").agg(F.array_sort(F.collect_set(F.struct("s", "least", "b"))).alias("l"))
    held = entries.select(F.col("mark").alias("b"), "ids", F.col("v").alias("bv"))
    near = materialize(best.select("a", F.explode(F.slice("l", 1, 2 * keep)).alias("x")).select("a", F.col("x.b").alias("b")))
    exact = near.join(held, "b").join(queries.select(F.col("mark").alias("a"), F.col("v").alias("av")), "a")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_stack(batch.column(c), dims) for c in (1, 2))
            dot = (x * y).sum(axis=1)
            s = dot / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
            odd = ~np.isfinite(s) | (dot == 0)
            if odd.any():
                s[odd] = (_unit(x[odd]) * _unit(y[odd])).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(s)], ["a", "ids", "s"])

    scored = exact.select("a", "av", "bv", "ids").mapInArrow(rerank, "a long, ids array<long>, s double")
    ranked = scored.select("a", (-F.col("s")).alias("s"), F.explode("ids").alias("n"))
    listed = ranked.groupBy("a").agg(F.slice(F.array_sort(F.collect_set(F.struct("s", "n"))), 1, 4 * keep).alias("l"))
    asked = good.where("q").select("id", "v").distinct().join(entries.where("q").select("v", F.col("mark").alias("a")), "v").select("id", "a")
    own = asked.join(materialize(listed), "a").select("id", F.slice(F.filter("l", lambda x: x["n"] != F.col("id")), 1, k).alias("l"))
    rows_out = own.select(F.col("id").alias("query_id"), F.posexplode("l").alias("p", "x"))
    return rows_out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.n").alias(key), (-F.col("x.s")).alias("score"))

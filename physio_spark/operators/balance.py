"""Nearest neighbours and synthetic over-sampling of minority classes."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from physio_spark.functions.columns import finite, portable_hash, uniform
from physio_spark.operators.clean import class_counts
from physio_spark.operators.ordered import smallest
from physio_spark.runtime import materialize

TILE_ROWS = 4_000
COPIES_PER_ROW = 1_000
MAX_BLOCKS = 24  # of a side: a row is sent that often at most, up to BLOCK_ROWS times as many rows
BLOCK_ROWS = 25_000  # a task holds two blocks


def nearest_neighbours(
    queries: DataFrame, data: DataFrame, key: str, vector: str, k: int, tile: int = TILE_ROWS
) -> DataFrame:
    """Exact ``k`` nearest rows of ``data`` for every query, itself excluded: ``key, neighbour, dist2, rank``.

    Queries and data are cut into blocks by hash, of ``tile`` rows or, in larger tables, of a ``MAX_BLOCKS``-th of
    the data (``BLOCK_ROWS`` at most); each pair of blocks is one piece of work and returns at most ``k`` rows
    per query, never its pairs.  So a task holds two blocks, and a row travels once for each block of the other side.
    """
    size = data.count()
    if not size:
        raise ValueError("no rows to search")
    block = max(tile, min(BLOCK_ROWS, math.ceil(size / MAX_BLOCKS)))
    tiles, parts = math.ceil(size / block), max(1, math.ceil(queries.count() / block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # seeds keep the places of a row as a query and as data apart
    of = lambda c, n, seed: F.pmod(F.xxhash64(F.lit(seed), c), F.lit(n)).cast("int")
    asked = queries.select(F.col(key).alias("_q"), F.col(vector).alias("_qv"), of(F.col(key), parts, 1).alias("_part"))
    placed = data.select(F.col(key).alias("_d"), F.col(vector).alias("_dv"), of(F.col(key), tiles, 2).alias("_tile"))
    asked, placed = asked.withColumn("_tile", every(tiles)), placed.withColumn("_part", every(parts))

    id_type = data.schema[key].dataType
    out_schema = T.StructType(
        [T.StructField("_q", id_type), T.StructField("_d", id_type), T.StructField("dist2", T.DoubleType())]
    )

    def closest(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        frames = [pd.DataFrame({"_q": [], "_d": [], "dist2": []})]
        if not len(q) or not len(d):
            return frames[0]
        qv, dv = (np.stack(x.to_numpy()).astype(float) for x in (q["_qv"], d["_dv"]))
        ask, ids = q["_q"].to_numpy(), d["_d"].to_numpy()
        (qv, ask), (dv, ids) = ((v[ok], i[ok]) for v, i, ok in ((v, i, np.isfinite(v).all(1)) for v, i in ((qv, ask), (dv, ids))))
        if not len(ids):
            return frames[0]
        norms, take, heaps = (dv**2).sum(1), min(k, len(ids)), len(ids) // 16
        for lo in range(0, len(ask), 512):
            own, v = ask[lo : lo + 512], qv[lo : lo + 512]
            lengths = (v**2).sum(1)
            dist = lengths[:, None] + norms[None, :] - 2 * v @ dv.T
            dist[own[:, None] == ids[None, :]] = np.inf
            # The k-th smallest of the minima of heaps is no less than the k-th distance.
            if heaps >= take:
                least = dist[:, : 16 * heaps].reshape(len(v), 16, heaps).min(1)
                bound = np.partition(least, take - 1, axis=1)[:, take - 1]
            else:
                bound = np.full(len(v), np.inf)
            bound += 1e-9 * (lengths + norms.max())  # what cancellation may have moved
            row, col = np.nonzero((dist <= bound[:, None]) & np.isfinite(dist))
            # Distances of the few that are left are computed directly, free of cancellation.
            exact = [((v[row[a : a + 100_000]] - dv[col[a : a + 100_000]]) ** 2).sum(1) for a in range(0, len(row), 100_000)]
            near = pd.DataFrame({"_row": row, "_q": own[row], "_d": ids[col], "dist2": np.concatenate([*exact, []])})
            frames.append(near.sort_values(["_row", "dist2", "_d"]).groupby("_row").head(k).drop(columns="_row"))
        return pd.concat(frames[1:] or frames)

    met = asked.groupBy("_part", "_tile").cogroup(placed.groupBy("_part", "_tile")).applyInPandas(closest, out_schema)
    order = Window.partitionBy("_q").orderBy("dist2", "_d")
    first = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return first.select(F.col("_q").alias(key), F.col("_d").alias("neighbour"), "dist2", "rank")


def smote(
    df: DataFrame,
    features: Sequence[str],
    label: str = "label",
    key: str = "window_id",
    k: int = 3,
    variant: str = "plain",
    m: int = 10,
    seed: int = 42,
    tile: int = TILE_ROWS,
) -> DataFrame:
    """Raise every class to the size of the largest one with points between minority neighbours.

    ``k`` is lowered to the smallest class minus one; fewer than two classes, or a class of one row,
    leave the frame as it is.  ``borderline`` starts only from minority rows of whose ``m`` nearest
    rows at least half, but not all, belong to other classes.  Adds the column ``synthetic``.
    """
    original = df.withColumn("synthetic", F.lit(False))
    counts = class_counts(df, label)
    if len(counts) < 2 or min(counts.values()) <= 1:
        return original
    k = max(1, min(k, min(counts.values()) - 1))
    goal = max(counts.values())
    base = materialize(df.select(F.col(key), F.col(label), F.array(*[finite(c) for c in features]).alias("_v")))
    out = original
    for cls, n in sorted(counts.items(), key=lambda item: str(item[0])):
        need = goal - n
        if need <= 0:
            continue
        members = base.where(F.col(label) == cls)
        starts = members
        if variant == "borderline":
            around = nearest_neighbours(members, base, key, "_v", min(m, sum(counts.values()) - 1), tile)
            named = around.join(base.select(F.col(key).alias("neighbour"), F.col(label).alias("_other")), "neighbour")
            foreign = named.groupBy(key).agg(F.avg((F.col("_other") != cls).cast("double")).alias("_share"))
            edge = foreign.where((F.col("_share") >= 0.5) & (F.col("_share") < 1.0))
            starts = materialize(members.join(edge.select(key), key, "left_semi"))
        available = n if variant != "borderline" else starts.count()
        if not available:
            continue
        near = nearest_neighbours(starts, members, key, "_v", k, tile)
        vectors = members.select(F.col(key).alias("neighbour"), F.col("_v").alias("_nv"))
        lists = near.join(vectors, "neighbour").groupBy(key).agg(
            F.array_sort(F.collect_list(F.struct("rank", F.col("_nv").alias("v")))).alias("_near")
        )
        each, rest = divmod(need, available)
        seeds = smallest(starts, [], portable_hash(seed, key), rest, [key]) if rest else starts.withColumn("_chosen", F.lit(False))
        copies = F.lit(each) + F.col("_chosen").cast("int")
        born = (
            seeds.join(lists, key)
            .withColumn("_copies", copies)
            .where("_copies > 0")
            .withColumn("_c", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / COPIES_PER_ROW).cast("int"))))
            .repartition(key, "_c")  # the copies of one seed are born in many tasks
            .withColumn("_i", F.explode(F.sequence(F.col("_c") * COPIES_PER_ROW + 1, F.least("_copies", (F.col("_c") + 1) * COPIES_PER_ROW))))
            .drop("_c")
        )
        pick = F.floor(uniform(seed + 1, key, "_i") * F.size("_near")).cast("int")
        gap = uniform(seed + 2, key, "_i")
        born = born.withColumn("_nv", F.get("_near", pick)["v"]).withColumn("_u", gap)
        value = lambda i: F.get("_v", i) + F.col("_u") * (F.get("_nv", i) - F.get("_v", i))
        made = born.select(
            F.lit(cls).cast(df.schema[label].dataType).alias(label),
            *[value(i).cast(df.schema[c].dataType).alias(c) for i, c in enumerate(features)],
            F.lit(True).alias("synthetic"),
        )
        out = out.unionByName(made, allowMissingColumns=True)
    return out

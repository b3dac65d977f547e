"""Group-aware folds: every subject is validated in exactly one fold."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from physio_spark.functions.columns import portable_hash
from physio_spark.operators.ordered import attach, numbered, ranked
from physio_spark.runtime import materialize


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))


def group_kfold(
    df: DataFrame,
    group: str = "subject",
    k: int = 5,
    stratify: str | None = None,
    method: str = "greedy",
    fold: str = "fold",
) -> DataFrame:
    """Add the number (1..k) of the fold in which a row is validated.  A null group is an error."""
    return attach(df, fold_table(df, group, k, stratify, method, fold), [group], salts=16)


def fold_table(
    df: DataFrame,
    group: str = "subject",
    k: int = 5,
    stratify: str | None = None,
    method: str = "greedy",
    fold: str = "fold",
) -> DataFrame:
    """Fold of every group, by one rule at every size.

    ``greedy`` gives the next largest group (ties by id) to the fold with the fewest rows.  The walk goes
    over the distinct group sizes, of which there are fewer than the square root of twice the rows;
    groups of one size are told apart by their rank and never gathered.  With ``stratify`` the next
    group goes to the fold that leaves the class shares most even (:class:`EvenWalk`); that walk goes over the
    distinct class counts.  ``snake`` deals the groups by size back and forth over the folds.
    """
    if method not in ("greedy", "snake"):
        raise ValueError(f"method is greedy or snake, not {method}")
    if stratify is not None and method == "snake":
        raise ValueError("snake does not look at classes; use greedy to stratify")
    sizes = group_sizes(df, group)
    checked = F.when(F.col(group).isNull(), F.raise_error(F.lit(f"a row has no {group}"))).otherwise(F.lit(True))
    sizes = sizes.where(checked.cast("boolean"))
    if method == "snake":
        return _snake(sizes, group, k, fold)
    if stratify is None:
        return _lightest(materialize(sizes), group, k, fold)

    return _most_even(df.where(F.col(stratify).isNotNull()), sizes, group, stratify, k).select(group, F.col("_fold").alias(fold))


class EvenWalk:
    """Deals groups to ``k`` folds so that every class has like shares everywhere.

    A group, given as its count of each class, goes to the fold that leaves the mean (over the classes) of the
    deviation of the folds' shares least; ties go to the fold with the smaller sum of shares, then to the
    first.  Only differences between folds matter, and they are whole numbers: when they return, the
    choices since then repeat, so a long run of equal groups is dealt by its cycle.
    """

    def __init__(self, k: int, totals: Sequence[int]) -> None:
        self.held = np.zeros((k, len(totals)), np.int64)
        self.totals = np.maximum(np.asarray(totals, float), 1.0)

    def _ahead(self) -> np.ndarray:
        return self.held - self.held.min(axis=0)

    def _next(self, counts: np.ndarray) -> int:
        k = len(self.held)
        ahead = self._ahead()
        trials = (ahead[None] + np.eye(k, dtype=np.int64)[:, :, None] * counts) / self.totals
        uneven = trials.std(axis=1).mean(axis=1).round(12)
        load = (ahead / self.totals).sum(axis=1).round(12)
        return int(np.lexsort((np.arange(k), load, uneven))[0])

    def deal(self, counts: Sequence[int], n: int) -> list[tuple[int, int, list[int]]]:
        """(first rank, number of ranks, folds in turn) of ``n`` groups of these counts, ranks from 0."""
        own, k = np.asarray(counts, np.int64), len(self.held)
        seen, folds, out = {self._ahead().tobytes(): 0}, [], []
        while len(folds) < n:
            folds.append(self._next(own))
            self.held[folds[-1]] += own
            begun = seen.setdefault(self._ahead().tobytes(), len(folds))
            if begun < len(folds):
                cycle = folds[begun:]
                rest = n - len(folds)
                for f in range(k):  # whole turns, then the turn that is left
                    self.held[f] += own * (rest // len(cycle) * cycle.count(f) + cycle[: rest % len(cycle)].count(f))
                out.append((begun, n - begun, cycle))
                folds = folds[:begun]
                break
        runs: list[tuple[int, int, list[int]]] = []
        for rank, f in enumerate(folds):
            if runs and runs[-1][2] == [f]:
                runs[-1] = (runs[-1][0], runs[-1][1] + 1, [f])
            else:
                runs.append((rank, 1, [f]))
        return runs + out


def _most_even(df: DataFrame, sizes: DataFrame, group: str, stratify: str, k: int) -> DataFrame:
    """Folds by :class:`EvenWalk` over the distinct count vectors, most uneven first, then larger, then by vector.

    A vector with its multiplicity is one row, however many groups share it; the walk reads the vectors in
    order and keeps only the folds' counts.  Groups find their fold by their rank (by id) within their vector.
    """
    label = F.col(stratify).cast("string")
    per_class = {r["c"]: r["n"] for r in df.groupBy(label.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = sorted(per_class)
    totals = [per_class[c] for c in classes]
    counted = df.groupBy(group).agg(F.array(*[F.count_if(label == c) for c in classes]).alias("_v"))
    # groups without any labelled row stand in a vector of zeros
    none = F.array(*[F.lit(0).cast("long") for _ in classes]).cast("array<bigint>")
    vectors = sizes.select(group).join(counted, group, "left").select(group, F.coalesce("_v", none).alias("_v"))
    placed = materialize(numbered(vectors, [F.col("_v"), F.col(group)], "_pos"))
    kinds = placed.groupBy("_v").agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("_first"))
    square = F.aggregate("_v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    whole = F.aggregate("_v", F.lit(0).cast("long"), lambda a, x: a + x)
    order = [F.desc("_uneven"), F.desc("_sum"), F.asc("_v")]
    ordered = kinds.withColumns({"_uneven": square * len(classes) - whole * whole, "_sum": whole}).repartition(1).sortWithinPartitions(*order)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dealer = EvenWalk(k, totals)
        for rows in batches:
            runs = [dealer.deal(v, n) for v, n in zip(rows["_v"], rows["n"], strict=True)]
            yield pd.DataFrame({"_v": rows["_v"], "_first": rows["_first"], "_runs": runs})

    told = ordered.mapInPandas(walk, "_v array<bigint>, _first bigint, _runs array<struct<at:bigint,n:bigint,folds:array<int>>>")
    found = attach(placed, materialize(told), ["_v"], salts=16).withColumn("_rank", F.col("_pos") - F.col("_first"))
    run = F.get(F.filter("_runs", lambda r: (F.col("_rank") >= r["at"]) & (F.col("_rank") < r["at"] + r["n"])), F.lit(0))
    turn = F.get(F.col("_run")["folds"], ((F.col("_rank") - F.col("_run")["at"]) % F.size(F.col("_run")["folds"])).cast("int"))
    return found.withColumn("_run", run).select(group, (turn + 1).cast("int").alias("_fold"))


def _given(loads: np.ndarray, n: int, count: int) -> np.ndarray:
    """How many of ``count`` groups of size ``n`` each fold gets, always the lightest fold next (ties: the first)."""
    lo, hi = int(loads.min()), int(loads.max()) + n * count + 1
    below = lambda x: np.maximum(0, -((loads - x) // n))  # noqa: E731  groups given to folds while lighter than x
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if below(mid).sum() <= count else (lo, mid)
    out = below(lo)
    next_up = np.flatnonzero(loads + out * n == lo)
    out[next_up[: count - int(out.sum())]] += 1
    return out


def _ranks(loads: np.ndarray, n: int, ranks: np.ndarray) -> np.ndarray:
    """The fold (from 0) of the groups with these ranks (from 0) among those of size ``n``."""
    lo = np.full(len(ranks), loads.min())
    hi = loads.max() + n * (ranks + 1) + 1
    below = lambda x: np.maximum(0, -((loads[None, :] - x[:, None]) // n))
    while (hi - lo > 1).any():
        mid = (lo + hi) // 2
        fits = below(mid).sum(1) <= ranks
        lo, hi = np.where(fits, mid, lo), np.where(fits, hi, mid)
    had = below(lo)
    equal = loads[None, :] + had * n == lo[:, None]
    place = ranks - had.sum(1)
    return np.argmax((np.cumsum(equal, axis=1) == place[:, None] + 1) & equal, axis=1)


def _lightest(sizes: DataFrame, group: str, k: int, fold: str) -> DataFrame:
    """The greedy rule without gathering the groups: loads at the start of each size, then ranks within it."""
    hist = sizes.groupBy("n").count().orderBy(F.desc("n")).collect()
    loads, starts = np.zeros(k, np.int64), []
    for row in hist:
        starts.append((row["n"], loads.tolist()))
        loads = loads + row["n"] * _given(loads, row["n"], row["count"])
    order = [F.desc("n"), F.asc(group)]
    placed = materialize(sizes.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    local = placed.withColumn("_row", F.row_number().over(Window.partitionBy("_part", "n").orderBy(group)) - 1)
    earlier = Window.partitionBy("n").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part", "n").count().withColumn("_before", F.coalesce(F.sum("count").over(earlier), F.lit(0))).drop("count")
    table = sizes.sparkSession.createDataFrame(starts, "n long, _loads array<long>")
    ranked_ = local.join(offsets, ["_part", "n"]).join(table, "n").select(group, "n", (F.col("_row") + F.col("_before")).alias("_rank"), "_loads")

    @F.pandas_udf("int")
    def chosen(n: pd.Series, rank: pd.Series, start: pd.Series) -> pd.Series:
        out = np.zeros(len(n), np.int32)
        for size, at in n.groupby(n).indices.items():
            out[at] = _ranks(np.asarray(start.iloc[at[0]], np.int64), int(size), rank.to_numpy(np.int64)[at]) + 1
        return pd.Series(out)

    return ranked_.select(group, chosen("n", "_rank", "_loads").alias(fold))


def _snake(sizes: DataFrame, group: str, k: int, fold: str) -> DataFrame:
    """Rank the groups by size without gathering them: sizes in order, equal sizes in hash order."""
    hashed = sizes.withColumn("_h", portable_hash(0, group))
    part = F.conv(F.substring("_h", 1, 2), 16, 10).cast("int")
    within = ranked(hashed, ["n"], [F.col("_h"), F.col(group)], "_within", part)
    # Table of distinct sizes: how many groups are strictly larger (at most sqrt(2 * rows) rows).
    hist = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("_c"))
    larger = ranked_offsets(hist)
    place = F.col("_larger") + F.col("_within") - 1
    lap, seat = F.floor(place / k), F.pmod(place, F.lit(k))
    number = F.when(F.pmod(lap, F.lit(2)) == 0, seat).otherwise(k - 1 - seat) + 1
    return within.join(larger, "n").select(group, number.cast("int").alias(fold))


def ranked_offsets(hist: DataFrame) -> DataFrame:
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    return hist.select("n", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_larger"))


def fold_summary(df: DataFrame, group: str = "subject", label: str = "label", fold: str = "fold") -> DataFrame:
    """Rows, classes and subjects of the training and validation part of every fold.

    ``usable`` is false when either part lacks a class (such folds are skipped in training).  The
    subject lists are text in one row and grow with the number of subjects; ``fold_members`` has them as rows.
    """
    whole = materialize(df.groupBy(group, fold, label).agg(F.count(F.lit(1)).alias("n")))
    folds = sorted(r[fold] for r in whole.select(fold).distinct().collect())
    # Each row of the (small) group table counts once per fold, as training or validation.
    both = whole.withColumn("_f", F.explode(F.array(*[F.lit(f) for f in folds])))
    both = both.withColumn("_val", F.col(fold) == F.col("_f"))
    n, v = F.col("n"), F.col("_val")

    def ids(chosen):
        return F.concat_ws(",", F.array_sort(F.collect_set(F.when(chosen, F.col(group)))))

    out = both.groupBy(F.col("_f").alias(fold)).agg(
        F.sum(F.when(~v, n).otherwise(0)).alias("n_train_samples"),
        F.sum(F.when(v, n).otherwise(0)).alias("n_val_samples"),
        F.count_distinct(F.when(~v, F.col(label))).alias("train_classes"),
        F.count_distinct(F.when(v, F.col(label))).alias("val_classes"),
        ids(~v).alias("train_subjects"),
        ids(v).alias("val_subjects"),
    )
    classes = F.greatest("train_classes", "val_classes")
    return out.withColumn("usable", (classes >= 2) & (F.col("train_classes") == F.col("val_classes")))


def fold_members(df: DataFrame, group: str = "subject", fold: str = "fold") -> DataFrame:
    """``fold, role, <group>``: every group is validated in its own fold and trains in all others."""
    whole = df.select(group, F.col(fold).alias("_own")).distinct()
    folds = whole.select(F.col("_own").alias(fold)).distinct()
    role = F.when(F.col("_own") == F.col(fold), F.lit("val")).otherwise(F.lit("train"))
    return whole.join(F.broadcast(folds), how="cross").select(fold, role.alias("role"), group)

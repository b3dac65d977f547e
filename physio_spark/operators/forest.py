"""A regression forest that is grown and applied in tasks: no tree reaches the driver.

Rows are coded in at most 32 bins a feature.  A node with more than ``task_rows`` samples is split by histograms that
tasks sum up, and only these splits are known to the driver.  The rows of a smaller node come together in one task,
which grows all that is below the node and predicts the rows that fall there.  Bootstrap counts are hashes of row and
tree, the features that a node may split on are hashes of tree and node, so the forest does not depend on where its
rows are or on ``task_rows``.

Splits are those of Spark ML's forests: the largest drop of the variance among a third of the features, with at least
``min_leaf`` samples on either side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 32

# Samples of a node whose rows one task holds (64 features: 16 MB of codes).
TASK_ROWS = 1 << 18

# Points that stand for a feature's values in one task: ranks are right to 1/2048 of the rows.
POINTS = 1024

# Histogram cells and rows that are counted at a time.
CELLS, ROWS = 1 << 20, 1 << 15

_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


def predict(
    train: DataFrame,
    rows: DataFrame,
    width: int,
    trees: int = 400,
    depth: int = 30,
    min_leaf: int = 2,
    seed: int = 42,
    *,
    n: int,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """``_row, prediction``: the mean over the trees for each of ``rows``, from a forest on ``train`` (``n`` rows).

    Both have a unique integer ``_row`` and ``_v``, an array of ``width`` numbers; ``train`` has the target ``_y``.
    The large nodes of a level are split by one pass over ``train``.
    """
    known = train.select("_row", "_y", "_v")
    asked = rows.select("_row", F.lit(0.0).alias("_y"), "_v")
    cuts = thresholds(known, width)
    tried = width if trees == 1 else math.ceil(width / 3)
    splits: list[dict] = [{} for _ in range(trees)]
    large = [(tree, 1) for tree in range(trees)] if n > task_rows else []
    while large:
        found = _split_large(known, cuts, splits, large, tried, min_leaf, seed).collect()  # a row for each large node
        large = []
        for r in found:
            splits[r["tree"]][r["node"]] = (r["feature"], r["bin"])
            if r["node"].bit_length() < depth:
                large += [(r["tree"], 2 * r["node"] + side) for side, size in enumerate((r["left"], r["right"])) if size > task_rows]
    ends = [(tree, node) for tree in range(trees) for node in _ends(splits[tree])]
    tasks = min(len(ends), 1 + n * trees // ROWS)
    place = {end: i for i, end in enumerate(ends)}
    schema = "_task int, _group int, _count int, _row long, _y double, _codes binary"

    def dealt(bagged: bool):
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes, at, y = encode(batch, cuts), batch["_row"].to_numpy(), batch["_y"].to_numpy()
                for tree in range(trees):
                    count = bootstrap(seed, tree, at) if bagged else np.zeros(len(at), np.int32)
                    own = np.flatnonzero(count) if bagged else np.arange(len(at))
                    node = route(codes[own], splits[tree])
                    ids, which = np.unique(node, return_inverse=True)
                    group = np.array([place[tree, int(i)] for i in ids], np.int32)[which]
                    columns = [group % tasks, group, count[own].astype(np.int32), at[own], y[own]]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), _binary(codes[own])], schema.replace(",", "").split()[::2])

        return deal

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, tree = None, [], None
        for batch in batches:
            groups, counts, codes = batch["_group"].to_numpy(), batch["_count"].to_numpy(), _matrix(batch["_codes"], width)
            at, y = batch["_row"].to_numpy(), batch["_y"].to_numpy()
            told, borders = [], np.flatnonzero((np.diff(groups) != 0) | (np.diff(counts == 0) != 0)) + 1
            for a, z in zip([0, *borders], [*borders, len(groups)], strict=True):
                if a == z:
                    continue
                if groups[a] != group:
                    group, held, tree = groups[a], [], None
                if counts[a]:
                    held.append((codes[a:z].copy(), y[a:z].copy(), counts[a:z].copy()))
                elif held or tree is not None:  # a tree whose bootstrap sample is empty says nothing
                    if tree is None:
                        tree = grow(*map(np.concatenate, zip(*held, strict=True)), ends[group], depth, min_leaf, tried, seed)
                        held = []
                    told.append((at[a:z], apply(tree, codes[a:z])))
            if told:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*told, strict=True)], ["_row", "prediction"])

    both = known.mapInArrow(dealt(True), schema).unionByName(asked.mapInArrow(dealt(False), schema))
    placed = both.repartitionById(tasks, "_task").sortWithinPartitions("_group", F.col("_count") == 0, "_row").drop("_task")
    each = placed.mapInArrow(answer, "_row long, prediction double")
    return each.groupBy("_row").agg(F.avg("prediction").alias("prediction"))


# ---------------------------------------------------------------- bins


def thresholds(vectors: DataFrame, width: int, column: str = "_v") -> list[np.ndarray]:
    """At most 31 ascending thresholds for each feature, from all rows.

    Few different values are parted in the middle between neighbours, others into bins of about equal counts.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_values(batch[column], width) for batch in batches]
        if not sum(map(len, held)):
            return
        told = [_points(x) for x in np.concatenate(held).T]
        columns = [pa.array(np.arange(width, dtype=np.int32)), *(pa.array([x[i] for x in told]) for i in (0, 1))]
        yield pa.RecordBatch.from_arrays(columns, ["feature", "value", "count"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        values, which = np.unique(np.concatenate(pdf["value"].to_list()), return_inverse=True)
        counts = np.bincount(which, np.concatenate(pdf["count"].to_list()))
        return pd.DataFrame({"feature": pdf["feature"].iloc[:1], "cuts": [_cuts(values, counts)]})

    points = vectors.select(column).mapInArrow(summarise, "feature int, value array<double>, count array<bigint>")
    found = points.groupBy("feature").applyInPandas(merge, "feature int, cuts array<double>")
    known = {r["feature"]: np.array(r["cuts"], float) for r in found.collect()}  # a row for each feature
    return [known.get(i, np.zeros(0)) for i in range(width)]


def _points(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values and their counts, or as many points of evenly spaced ranks."""
    values, counts = np.unique(x, return_counts=True)
    if len(values) > POINTS:
        upto = np.arange(1, POINTS + 1) * len(x) // POINTS
        ranks = np.sort(x)[(upto + np.append(0, upto[:-1])) // 2]
        values, which = np.unique(ranks, return_inverse=True)
        counts = np.bincount(which, np.diff(upto, prepend=0)).astype(np.int64)
    return values, counts


def _cuts(values: np.ndarray, counts: np.ndarray) -> list[float]:
    middle = (values[1:] + values[:-1]) / 2
    if len(middle) < BINS:
        return middle.tolist()
    out, stride = [], counts.sum() / BINS
    goal, upto = stride, np.cumsum(counts).tolist()
    for i in range(1, len(upto)):  # a value closes a bin if the next one would miss the goal by more
        if abs(upto[i - 1] - goal) < abs(upto[i] - goal):
            out.append(float(middle[i - 1]))
            goal += stride
    return out[: BINS - 1]


def _values(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def encode(batch: pa.RecordBatch, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """The bin of each value: the number of thresholds below it."""
    x = _values(batch["_v"], len(cuts))
    return np.stack([np.searchsorted(own, x[:, i]).astype(np.uint8) for i, own in enumerate(cuts)], axis=1)


def _binary(codes: np.ndarray) -> pa.Array:
    offsets = np.arange(len(codes) + 1, dtype=np.int32) * np.int32(codes.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(codes))])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.cast(pa.binary())
    if not len(column):
        return np.zeros((0, width), np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), width)


# ---------------------------------------------------------------- chance


def _mixed(*parts) -> np.ndarray:
    """A 64-bit hash (splitmix64) of integers, element by element."""
    h = np.zeros(1, np.uint64)
    with np.errstate(over="ignore"):
        for part in parts:
            h = (h ^ np.asarray(part).astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return h


def bootstrap(seed: int, tree: int, rows: np.ndarray) -> np.ndarray:
    """How often a tree's sample holds each row (Poisson, mean 1)."""
    return np.searchsorted(_POISSON, (_mixed(seed, tree, rows) >> np.uint64(11)) * 2.0**-53, "right").astype(np.int32)


def tried_features(seed: int, tree: int, nodes: np.ndarray, width: int, tried: int) -> np.ndarray:
    """The features that each node may split on, in ascending order."""
    if tried >= width:
        return np.tile(np.arange(width), (len(nodes), 1))
    drawn = _mixed(~seed, tree, np.asarray(nodes)[:, None], np.arange(width)[None, :])
    return np.sort(np.argpartition(drawn, tried, axis=1)[:, :tried], axis=1)


# ---------------------------------------------------------------- splits


def _best(counts: np.ndarray, sums: np.ndarray, nodes: int, tried: int, min_leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Drop of the squares, tried column and last bin on the left of each node's best split, the first of equal ones.

    ``counts`` and ``sums`` have a cell for each node, tried column and bin; no node is without samples.
    """
    at = np.flatnonzero(counts)
    column = at // BINS
    begin = np.searchsorted(at, np.arange(nodes * tried) * BINS)
    end = np.append(begin[1:], len(at)) - 1

    def upto(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.cumsum(cells[at])
        own -= (own[begin] - cells[at[begin]])[column]
        return own, own[end][column]

    (n, whole), (s, total) = upto(counts), upto(sums)
    rest = whole - n
    d = s - total * n / whole
    gain = np.where((n >= min_leaf) & (rest >= min_leaf), d * d * whole / (n * np.maximum(rest, 1)), 0.0)
    best = np.maximum.reduceat(gain, begin[::tried])
    first = np.flatnonzero(gain >= best[column // tried] * (1 - 1e-9))  # equal but for rounding
    first = first[np.unique(column[first] // tried, return_index=True)[1]]
    return best, column[first] % tried, at[first] % BINS


def _cells(codes: np.ndarray, slot: np.ndarray, features: np.ndarray, weights: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Sums of each of ``weights`` by node (``slot``), tried column and bin."""
    nodes, tried = features.shape
    out = [np.zeros(nodes * tried * BINS) for _ in weights]
    for a in range(0, len(slot), ROWS):
        own = slot[a : a + ROWS]
        cell = np.take_along_axis(codes[a : a + ROWS], features[own], axis=1) + (own[:, None] * tried + np.arange(tried)) * BINS
        for total, weight in zip(out, weights, strict=True):
            total += np.bincount(cell.ravel(), np.repeat(weight[a : a + ROWS], tried), len(total))
    return out


def _split_large(known: DataFrame, cuts: list, splits: list[dict], large: list[tuple], tried: int, min_leaf: int, seed: int) -> DataFrame:
    """``tree, node, feature, bin, left, right`` (samples of the children) of the large nodes that can be split."""
    width, cells = len(cuts), tried * BINS
    nodes: dict[int, list[int]] = {}
    for tree, node in large:
        nodes.setdefault(tree, []).append(node)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[tuple, np.ndarray] = {}
        for batch in batches:
            codes, at, y = encode(batch, cuts), batch["_row"].to_numpy(), batch["_y"].to_numpy()
            for tree, own in nodes.items():
                weight = bootstrap(seed, tree, at)
                place = route(codes, splits[tree])
                for node in own:
                    here = np.flatnonzero((place == node) & (weight > 0))
                    w, v = weight[here].astype(float), y[here]
                    found = _cells(codes[here], np.zeros(len(here), int), tried_features(seed, tree, [node], width, tried), (w, w * v))
                    told[tree, node] = told.get((tree, node), 0) + np.concatenate([*found, [(w * v * v).sum()]])
        if told:
            names = ["tree", "node", "sums"]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in told], pa.int32()), pa.array([x for _, x in told], pa.int64()), pa.array(list(told.values()))], names)

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = np.sum(np.stack(pdf["sums"].to_list()), axis=0)
        tree, node = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
        n = sums[:BINS].sum()
        gain, column, last = _best(sums[:cells], sums[cells : 2 * cells], 1, tried, min_leaf) if n else (np.zeros(1), [0], [0])
        if not gain[0] > np.finfo(float).eps * sums[-1]:
            return pd.DataFrame({"tree": [], "node": [], "feature": [], "bin": [], "left": [], "right": []})
        left = sums[column[0] * BINS : column[0] * BINS + last[0] + 1].sum()
        feature = tried_features(seed, tree, [node], width, tried)[0, column[0]]
        return pd.DataFrame({"tree": [tree], "node": [node], "feature": [int(feature)], "bin": [int(last[0])], "left": [int(left)], "right": [int(n - left)]})

    counted = known.mapInArrow(count, "tree int, node long, sums array<double>")
    return counted.groupBy("tree", "node").applyInPandas(decide, "tree int, node long, feature int, bin int, left long, right long")


def _ends(splits: dict) -> list[int]:
    """Nodes (the children of ``i`` are ``2 i`` and ``2 i + 1``) that the splits known so far leave whole."""
    return sorted({2 * node + side for node in splits for side in (0, 1)} - splits.keys()) if splits else [1]


def route(codes: np.ndarray, splits: dict) -> np.ndarray:
    """The node of ``_ends`` that each row falls in."""
    node = np.ones(len(codes), np.int64)
    if not splits:
        return node
    ids = np.array(sorted(splits))
    feature, last = np.array([splits[i] for i in ids.tolist()]).T
    here = np.arange(len(codes))
    while len(here):
        at = np.minimum(np.searchsorted(ids, node[here]), len(ids) - 1)
        hit = ids[at] == node[here]
        here, at = here[hit], at[hit]
        node[here] = 2 * node[here] + (codes[here, feature[at]] > last[at])
    return node


def grow(
    codes: np.ndarray, y: np.ndarray, counts: np.ndarray, end: tuple[int, int], depth: int, min_leaf: int, tried: int, seed: int
) -> tuple[np.ndarray, ...]:
    """All nodes below ``end`` (tree and node), level by level: feature (-1 at a leaf), last bin on the left, left child, mean."""
    tree, node = end
    ids, rows, slot, out, known = np.array([node], np.int64), np.arange(len(y)), np.zeros(len(y), int), [], 0
    level = node.bit_length() - 1
    while len(ids):
        begin = np.searchsorted(slot, np.arange(len(ids)))
        v, w = y[rows], counts[rows].astype(float)
        n = np.add.reduceat(w, begin)
        mean = np.add.reduceat(w * v, begin) / n
        apart = v - mean[slot]
        squares = np.add.reduceat(w * apart * apart, begin)
        open_ = (np.minimum.reduceat(v, begin) < np.maximum.reduceat(v, begin)) & (n >= 2 * min_leaf) & (level < depth)
        feature, last = np.full(len(ids), -1), np.zeros(len(ids), int)
        nodes, own = np.flatnonzero(open_), np.flatnonzero(open_[slot])
        place = (np.cumsum(open_) - 1)[slot[own]]
        step = max(1, CELLS // (tried * BINS))
        for a in range(0, len(nodes), step):
            some = nodes[a : a + step]
            here = own[slice(*np.searchsorted(place, [a, a + step]))]
            features = tried_features(seed, tree, ids[some], codes.shape[1], tried)
            at = (np.cumsum(open_) - 1)[slot[here]] - a
            cells = _cells(codes[rows[here]], at, features, (w[here], w[here] * apart[here]))
            gain, column, bins = _best(*cells, len(some), tried, min_leaf)
            good = gain > np.finfo(float).eps * squares[some]
            feature[some[good]] = features[np.flatnonzero(good), column[good]]
            last[some[good]] = bins[good]
        split = feature >= 0
        child = known + len(ids) + 2 * (np.cumsum(split) - 1)
        out.append((feature, last, np.where(split, child, -1), mean))
        known += len(ids)
        keep = split[slot]
        rows, slot = rows[keep], slot[keep]
        slot = 2 * (np.cumsum(split) - 1)[slot] + (codes[rows, feature[slot]] > last[slot])
        order = np.argsort(slot, kind="stable")
        rows, slot = rows[order], slot[order]
        ids = (2 * ids[split][:, None] + np.arange(2)).ravel()
        level += 1
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def apply(tree: tuple[np.ndarray, ...], codes: np.ndarray) -> np.ndarray:
    """The mean of the leaf that each row falls in."""
    feature, last, child, mean = tree
    node, here = np.zeros(len(codes), int), np.arange(len(codes))
    while len(here):
        here = here[feature[node[here]] >= 0]
        at = node[here]
        node[here] = child[at] + (codes[here, feature[at]] > last[at])
    return mean[node]


__all__ = ["apply", "bootstrap", "grow", "predict", "thresholds"]

"""Statistics of overlapping windows from panes.

A block is cut into panes of the greatest common divisor of window length and step, so every window is a run of
whole panes.  A row is summarised in its pane once, whatever the overlap; windows are put together from the few
numbers of their panes (counts, extremes, central moments, and what happens at a pane's first and last row).
Panes travel to the stretch of windows that they belong to, and only there are they copied to each window, so
neither shuffle depends on length over step.

Moments are merged about the window's own mean, not as sums of squares, and keep their digits.  Order
statistics stay exact: panes then hold their values, windows order them.  Where a window would hold more than
``max_rows`` values, the windows are exploded and bracketed instead (:mod:`quantiles`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from physio_spark.functions.columns import finite
from physio_spark.operators.quantiles import GATHER_ROWS
from physio_spark.operators.signal import _starts, frequency_grid
from physio_spark.operators.stats import NEEDS_NEIGHBOURS, QUANTILE_NAMES, ZERO_WHEN_EMPTY, stats
from physio_spark.operators.windows import time_windows
from physio_spark.runtime import materialize

# Windows of a stretch, as a multiple of the windows that cover one row: 1/8 of the panes are in two stretches.
STRETCH = 8

# Numbers that a spectrum's task works on at a time.
VALUES = 1 << 18

MOMENTS = {"std0": 2, "std1": 2, "skew": 3, "kurtosis": 4}
SLOPES = {"slope", "slope_fs", "slope_fit"}
DIFFERENCES = {"diff_mean", "diff_std0", "diff_std1", "diff_positive"}
GATHERING = {*QUANTILE_NAMES, "mad", "zero_crossings"}
NEIGHBOURS = NEEDS_NEIGHBOURS - SLOPES
PLAIN = {"min": F.min, "max": F.max}
KNOWN = {"n", "mean", "min", "max", "range", "auc", "breath_rate", *MOMENTS, *SLOPES, *DIFFERENCES, *GATHERING}


def window_stats(
    blocked: DataFrame,
    by: Sequence[str],
    cols: Sequence[str],
    spec: Sequence[str],
    length: int,
    step: int,
    t: str = "t",
    anchor: str = "block_start",
    end: str = "block_end",
    *,
    fs: float = 1.0,
    unit: float = 1e6,
    max_rows: int = GATHER_ROWS,
    empty: float | None = 0.0,
    extra: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Statistics ``<c>_<name>`` of the windows of :func:`time_windows`, as :func:`stats` defines them.

    Output: ``by``, ``win``, ``win_start``, ``win_end``, ``n_rows``, the statistics, and ``extra``: the plain
    mean, min or max of further columns (``{name: (how, column)}``).  ``anchor`` and ``end`` must be the same in
    all rows of a block.  Statistics of neighbours need the columns of :func:`with_neighbours`.
    """
    by, cols, spec, extra = list(by), list(cols), list(spec), dict(extra or {})
    if unknown := set(spec) - KNOWN:
        raise ValueError(f"unknown statistics {sorted(unknown)}")
    wanted = [t, anchor, end, *cols, *[c for _, c in extra.values()]]
    if set(spec) & {"slope_fs", "slope_fit"}:
        wanted.append("idx")
    if set(spec) & NEIGHBOURS:
        wanted += [f"prev_{t}", f"next_{t}", *[f"{side}_{c}" for c in cols for side in ("prev", "next")]]
    rows = blocked.select(*by, *[c for c in dict.fromkeys(wanted) if c not in by])
    pane = math.gcd(length, step)
    if set(spec) & GATHERING:
        rows = materialize(rows)
        if _fullest(rows, by, length, step, pane, t, anchor, end) > max_rows:
            return _exploded(rows, by, cols, spec, length, step, t, anchor, end, fs, unit, max_rows, empty, extra)
    inside = _in_windows(rows, length, step, pane, t, anchor, end)
    states = [s for c in cols for s in _pane_states(c, spec, t, fs, unit, anchor)]
    for name, (how, c) in extra.items():
        states += [F.count(finite(c)).alias(f"{name}|k"), F.sum(finite(c)).alias(f"{name}|s")] if how == "mean" else [PLAIN[how](c).alias(f"{name}|{how}")]
    panes = inside.groupBy(*by, anchor, end, "_pane").agg(F.count(F.lit(1)).alias("_rows"), *states)
    placed = _dealt(panes, by, length, step, pane, anchor, end)
    merged = [a for c in cols for a in _merged(c, spec)]
    merged += [(F.sum(f"{n}|s") / F.sum(f"{n}|k") if how == "mean" else PLAIN[how](f"{n}|{how}")).alias(n) for n, (how, _) in extra.items()]
    start = (F.col(anchor) + F.col("win") * F.lit(step)).alias("win_start")
    out = placed.groupBy(*by, "_stretch", anchor, "win").agg(F.sum("_rows").alias("n_rows"), *merged)
    for level in _results(cols, spec, fs):  # each level reads the columns of the one before
        out = out.select("*", *level)
    if empty is not None:
        zero = {f"{c}_{s}": F.coalesce(F.col(f"{c}_{s}"), F.lit(float(empty))) for c in cols for s in spec if s in ZERO_WHEN_EMPTY}
        out = out.withColumns(zero) if zero else out
    return out.select(*by, "win", start, (start + F.lit(length)).alias("win_end"), "n_rows", *[f"{c}_{s}" for c in cols for s in spec], *extra)


def _in_windows(rows: DataFrame, length: int, step: int, pane: int, t: str, anchor: str, end: str) -> DataFrame:
    """Rows that some whole window of their block covers, with the number and bounds of their pane."""
    at, last = F.col(t) - F.col(anchor), F.floor((F.col(end) - F.col(anchor) - F.lit(length)) / F.lit(step))
    covered = (last >= 0) & (at >= 0) & (at < last * F.lit(step) + F.lit(length))
    if step > length:
        covered = covered & (at % F.lit(step) < F.lit(length))
    numbered = rows.where(covered).withColumn("_pane", F.floor(at / F.lit(pane)))
    return numbered.withColumn("_from", F.col(anchor) + F.col("_pane") * F.lit(pane)).withColumn("_to", F.col("_from") + F.lit(pane))


def windows_per_stretch(length: int, step: int) -> int:
    return STRETCH * -(-length // step)


def _stretched(panes: DataFrame, by: list[str], length: int, step: int, pane: int, anchor: str, end: str) -> DataFrame:
    """Each pane, with its first and last window, on the task of every stretch that it reaches."""
    span, hop = length // pane, step // pane
    per_stretch = windows_per_stretch(length, step)
    first = F.greatest(F.lit(0), F.floor((F.col("_pane") - span) / F.lit(hop)) + 1).cast("bigint")
    last = F.least(F.floor(F.col("_pane") / F.lit(hop)), F.floor((F.col(end) - F.col(anchor) - F.lit(length)) / F.lit(step))).cast("bigint")
    halo = panes.withColumns({"_first": first, "_last": last}).where("_first <= _last")
    stretch = lambda c: F.floor(F.col(c) / F.lit(per_stretch)).cast("bigint")
    halo = halo.withColumn("_stretch", F.explode(F.sequence(stretch("_first"), stretch("_last"))))
    return halo.repartition(*by, "_stretch")


def _dealt(panes: DataFrame, by: list[str], length: int, step: int, pane: int, anchor: str, end: str) -> DataFrame:
    """One row for each pane and window, on the task of the window's stretch."""
    per_stretch = windows_per_stretch(length, step)
    dealt = _stretched(panes, by, length, step, pane, anchor, end)
    own = F.sequence(F.greatest(F.col("_first"), F.col("_stretch") * per_stretch), F.least(F.col("_last"), F.col("_stretch") * per_stretch + per_stretch - 1))
    return dealt.withColumn("win", F.explode(own)).withColumn("_win_start", F.col(anchor) + F.col("win") * F.lit(step)).withColumn("_win_end", F.col("_win_start") + F.lit(length))


def _fullest(rows: DataFrame, by: list[str], length: int, step: int, pane: int, t: str, anchor: str, end: str) -> int:
    """Rows of the fullest window, from the counts of panes."""
    counted = _in_windows(rows, length, step, pane, t, anchor, end).groupBy(*by, anchor, end, "_pane").agg(F.count(F.lit(1)).alias("_rows"))
    sizes = _dealt(counted, by, length, step, pane, anchor, end).groupBy(*by, "_stretch", "win").agg(F.sum("_rows").alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def _exploded(rows, by, cols, spec, length, step, t, anchor, end, fs, unit, max_rows, empty, extra) -> DataFrame:
    """The same from rows copied to each of their windows."""
    key = [*by, "win", "win_start", "win_end"]
    windowed = materialize(time_windows(rows, length, step, t, anchor, end))
    out = stats(windowed, key, cols, spec, t, fs=fs, window=("win_start", "win_end"), unit=unit, max_rows=max_rows, empty=empty)
    if not extra:
        return out
    plain = [(F.avg(finite(c)) if how == "mean" else PLAIN[how](c)).alias(n) for n, (how, c) in extra.items()]
    return out.join(windowed.groupBy(*key).agg(*plain), key)


# ---------------------------------------------------------------- states of a pane


def _moment_states(name: str, y: Column, order: int) -> list[Column]:
    """Count, sum and central moments (sums, not means) up to an order."""
    n, m2 = F.count(y), F.coalesce(F.var_pop(y), F.lit(0.0)) * F.count(y)
    out = [n.alias(f"{name}|n"), F.sum(y).alias(f"{name}|s")]
    if order >= 2:
        out.append(m2.alias(f"{name}|m2"))
    if order >= 3:
        out.append(F.when((n > 1) & (m2 > 0), F.skewness(y) * F.pow(m2, 1.5) / F.sqrt(n)).otherwise(F.lit(0.0)).alias(f"{name}|m3"))
    if order >= 4:
        out.append(F.when((n > 1) & (m2 > 0), (F.kurtosis(y) + 3.0) * m2 * m2 / n).otherwise(F.lit(0.0)).alias(f"{name}|m4"))
    return out


def _pane_states(c: str, spec: list[str], t: str, fs: float, unit: float, anchor: str) -> list[Column]:
    names = set(spec)
    y = finite(c)
    out = _moment_states(c, y, max([1, *[MOMENTS[s] for s in names & MOMENTS.keys()]]))
    out += [F.min(y).alias(f"{c}|min"), F.max(y).alias(f"{c}|max")]
    for kind, x in (("t", (F.col(t) - F.col(anchor)) / F.lit(unit)), ("i", F.col("idx").cast("double"))):
        if names & ({"slope"} if kind == "t" else {"slope_fs", "slope_fit"}):
            own = F.when(y.isNotNull(), x)
            out += [F.sum(own).alias(f"{c}|{kind}s"), F.min(own).alias(f"{c}|{kind}min"), F.max(own).alias(f"{c}|{kind}max")]
            out += [(F.var_pop(own) * F.count(own)).alias(f"{c}|{kind}xx"), (F.covar_pop(own, y) * F.count(own)).alias(f"{c}|{kind}xy")]
    if not names & NEIGHBOURS:
        return out + ([F.collect_list(y).alias(f"{c}|all")] if names & GATHERING else [])
    before, after = finite(f"prev_{c}"), finite(f"next_{c}")
    # the pane's first row has its neighbour in an earlier pane: it counts where that one is in the window
    opens, closes = F.col(f"prev_{t}") < F.col("_from"), F.col(f"next_{t}") >= F.col("_to")
    inner = F.coalesce(F.col(f"prev_{t}") >= F.col("_from"), F.lit(False))
    out.append(F.max(F.when(opens, F.col(f"prev_{t}"))).alias(f"{c}|before"))
    if names & DIFFERENCES:
        rise = (y - before) * F.lit(float(fs))
        own = F.when(inner, rise)
        out += _moment_states(f"{c}|d", own, 2)
        out += [F.min(own).alias(f"{c}|dmin"), F.max(own).alias(f"{c}|dmax"), F.sum((own > 0).cast("int")).alias(f"{c}|up"), F.max(F.when(opens, rise)).alias(f"{c}|first")]
    if "auc" in names:
        area = (y + before) / 2 / F.lit(float(fs))
        out += [F.sum(F.when(inner, area)).alias(f"{c}|auc"), F.max(F.when(opens, area)).alias(f"{c}|auc1")]
    if "breath_rate" in names:
        turn = F.coalesce((y - before > 0) & (after - y <= 0), F.lit(False))
        inside = inner & F.coalesce(~closes, F.lit(False))
        out.append(F.sum((turn & inside).cast("int")).alias(f"{c}|turns"))
        for name, edge in (("turn1", F.coalesce(opens, F.lit(False))), ("turn2", inner & F.coalesce(closes, F.lit(False)))):
            told = F.struct(F.col(f"prev_{t}").alias("p"), F.col(f"next_{t}").alias("q"))
            out.append(F.max(F.when(turn & edge, told)).alias(f"{c}|{name}"))
    if "zero_crossings" in names:
        pair = F.when(y.isNotNull() & before.isNotNull(), F.struct(y.alias("y"), before.alias("b")))
        out += [F.collect_list(F.when(inner, pair)).alias(f"{c}|pairs"), F.max(F.when(opens, pair)).alias(f"{c}|pair1")]
    if names & (GATHERING - {"zero_crossings"}):
        out.append(F.collect_list(y).alias(f"{c}|all"))
    return out


# ---------------------------------------------------------------- windows from their panes


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _merged(c: str, spec: list[str]) -> list[Column]:
    names = set(spec)
    order = max([1, *[MOMENTS[s] for s in names & MOMENTS.keys()]])
    total = lambda name: F.sum(_col(f"{c}|{name}")).alias(f"{c}|{name}")
    least = lambda name: F.min(_col(f"{c}|{name}")).alias(f"{c}|{name}")
    most = lambda name: F.max(_col(f"{c}|{name}")).alias(f"{c}|{name}")
    parts = lambda name, *fields: F.collect_list(F.struct(*[_col(f"{c}|{f}").alias(f) for f in fields])).alias(f"{c}|{name}")
    out = [total("n"), total("s"), least("min"), most("max")]
    if order >= 2:
        out.append(parts("parts", "n", "s", *[f"m{i}" for i in range(2, order + 1)]))
    for kind in ("t", "i"):
        if names & ({"slope"} if kind == "t" else {"slope_fs", "slope_fit"}):
            out += [total(f"{kind}s"), least(f"{kind}min"), most(f"{kind}max"), parts(f"{kind}parts", "n", "s", f"{kind}s", f"{kind}xx", f"{kind}xy")]
    joins = F.coalesce(_col(f"{c}|before") >= F.col("_win_start"), F.lit(False))  # the first row's neighbour is in the window
    if names & DIFFERENCES:
        first = F.when(joins, _col(f"{c}|first"))
        out += [total("d|n"), total("d|s"), parts("dparts", "d|n", "d|s", "d|m2"), F.collect_list(first).alias(f"{c}|firsts")]
        out += [(F.coalesce(F.sum(_col(f"{c}|up")), F.lit(0)) + F.count(F.when(first > 0, 1))).alias(f"{c}|up")]
        out += [F.min(F.least(_col(f"{c}|dmin"), first)).alias(f"{c}|dmin"), F.max(F.greatest(_col(f"{c}|dmax"), first)).alias(f"{c}|dmax")]
    if "auc" in names:
        out.append(F.sum(F.coalesce(_col(f"{c}|auc"), F.lit(0.0)) + F.coalesce(F.when(joins, _col(f"{c}|auc1")), F.lit(0.0))).alias(f"{c}|auc"))
    if "breath_rate" in names:
        edges = [F.coalesce((_col(f"{c}|{e}")["p"] >= F.col("_win_start")) & (_col(f"{c}|{e}")["q"] < F.col("_win_end")), F.lit(False)).cast("int") for e in ("turn1", "turn2")]
        out.append(F.sum(F.coalesce(_col(f"{c}|turns"), F.lit(0)) + edges[0] + edges[1]).alias(f"{c}|turns"))
    if "zero_crossings" in names:
        out += [F.flatten(F.collect_list(_col(f"{c}|pairs"))).alias(f"{c}|pairs"), F.collect_list(F.when(joins, _col(f"{c}|pair1"))).alias(f"{c}|pair1")]
    if names & (GATHERING - {"zero_crossings"}):
        out.append(F.sort_array(F.flatten(F.collect_list(_col(f"{c}|all")))).alias(f"{c}|all"))
    return out


def _about(parts: Column, mean: Column, order: int, n: str = "n", s: str = "s", m: str = "m") -> Column:
    """The sum of the ``order``-th powers of the distances to ``mean``, from the central moments of the panes."""

    def add(total: Column, p: Column) -> Column:
        d = F.coalesce(p[s] / p[n], mean) - mean
        terms = p[n] * F.pow(d, F.lit(float(order)))
        for k in range(2, order + 1):  # a pane's first central moment is 0
            terms = terms + F.lit(float(math.comb(order, k))) * F.coalesce(p[f"{m}{k}"], F.lit(0.0)) * F.pow(d, F.lit(float(order - k)))
        return total + terms

    return F.aggregate(parts, F.lit(0.0), add)


def _squares(values: Column, centre: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - centre) * (x - centre))


def _distances(values: Column, centre: Column) -> Column:
    return F.transform(values, lambda x: F.abs(x - centre))


def _quantile(ordered: Column, p: float) -> Column:
    at = F.lit(float(p)) * (F.size(ordered) - 1)
    low = F.get(ordered, F.floor(at).cast("int"))
    high = F.get(ordered, F.least(F.floor(at) + 1, F.size(ordered) - 1).cast("int"))
    return F.when(F.size(ordered) > 0, low + (at - F.floor(at)) * (high - low))


def _results(cols: list[str], spec: list[str], fs: float) -> list[list[Column]]:
    levels: list[list[Column]] = [[], [], []]
    names = set(spec)
    order = max([1, *[MOMENTS[s] for s in names & MOMENTS.keys()]])
    for c in cols:
        own = lambda name, c=c: _col(f"{c}|{name}")
        n, flat = own("n"), own("min") == own("max")
        levels[0].append((own("s") / n).alias(f"{c}|mu"))
        for k in range(2, order + 1):
            levels[1].append(F.when(flat, F.lit(0.0)).otherwise(_about(own("parts"), own("mu"), k)).alias(f"{c}|w{k}"))
        if names & DIFFERENCES:
            count = own("d|n") + F.size(own("firsts"))
            sums = F.coalesce(own("d|s"), F.lit(0.0)) + F.aggregate(own("firsts"), F.lit(0.0), lambda a, x: a + x)
            levels[0] += [count.alias(f"{c}|dn"), F.when(count > 0, sums / count).alias(f"{c}|dmu")]
            spread = _about(own("dparts"), own("dmu"), 2, "d|n", "d|s", "d|m") + _squares(own("firsts"), own("dmu"))
            levels[1].append(F.when(own("dmin") == own("dmax"), F.lit(0.0)).otherwise(spread).alias(f"{c}|dw"))
        if "mad" in names:
            levels[0].append(_quantile(own("all"), 0.5).alias(f"{c}|middle"))
            levels[1].append(F.sort_array(_distances(own("all"), own("middle"))).alias(f"{c}|apart"))
        for name in spec:
            levels[2].append(_result(c, name, own, fs).alias(f"{c}_{name}"))
    return [level for level in levels if level]


def _slope(own, kind: str) -> Column:
    n, mx, my = own("n"), own(f"{kind}s") / own("n"), own("mu")

    def shift(p: Column) -> tuple[Column, Column]:
        return F.coalesce(p[f"{kind}s"] / p["n"], mx) - mx, F.coalesce(p["s"] / p["n"], my) - my

    def add(field: str, product):
        return F.aggregate(own(f"{kind}parts"), F.lit(0.0), lambda a, p: a + F.coalesce(p[field], F.lit(0.0)) + p["n"] * product(*shift(p)))

    xx, xy = add(f"{kind}xx", lambda dx, dy: dx * dx), add(f"{kind}xy", lambda dx, dy: dx * dy)
    return F.when((n < 2) | (own(f"{kind}min") == own(f"{kind}max")), F.lit(0.0)).otherwise(xy / xx)


def _result(c: str, name: str, own, fs: float) -> Column:
    n, rate = own("n"), F.lit(float(fs))
    if name == "n":
        return n
    if name == "mean":
        return own("mu")
    if name in ("min", "max"):
        return own(name)
    if name == "range":
        return own("max") - own("min")
    if name == "std0":
        return F.sqrt(own("w2") / n)
    if name == "std1":
        return F.when(n < 2, F.lit(0.0)).otherwise(F.sqrt(own("w2") / (n - 1)))
    if name == "skew":
        return F.when(n >= 3, F.when(own("w2") > 0, F.sqrt(n) * own("w3") / F.pow(own("w2"), 1.5)).otherwise(F.lit(0.0)))
    if name == "kurtosis":
        return F.when(n >= 4, F.when(own("w2") > 0, n * own("w4") / (own("w2") * own("w2")) - 3.0).otherwise(F.lit(-3.0)))
    if name == "slope":
        return _slope(own, "t")
    if name == "slope_fs":
        return _slope(own, "i") * rate
    if name == "slope_fit":
        return F.when(n >= 3, _slope(own, "i"))
    if name == "diff_mean":
        return own("dmu")
    if name == "diff_std0":
        return F.when(own("dn") > 0, F.sqrt(own("dw") / own("dn")))
    if name == "diff_std1":
        return F.when(own("dn") < 2, F.lit(0.0)).otherwise(F.sqrt(own("dw") / (own("dn") - 1)))
    if name == "diff_positive":
        return F.when(own("dn") > 0, own("up") / own("dn"))
    if name == "auc":
        return own("auc")
    minutes = F.greatest(n / rate, F.lit(1e-6)) / 60.0
    if name == "breath_rate":
        return F.when(n < 3, F.lit(0.0)).otherwise(own("turns") / minutes)
    if name == "zero_crossings":
        flips = lambda p: (p["y"] - own("mu") < 0) != (p["b"] - own("mu") < 0)
        seconds = F.greatest(n / F.greatest(rate, F.lit(1e-6)), F.lit(1e-6))
        return (F.size(F.filter(own("pairs"), flips)) + F.size(F.filter(own("pair1"), flips))) / seconds
    if name == "mad":
        return _quantile(own("apart"), 0.5)
    ps = QUANTILE_NAMES[name]
    high = _quantile(own("all"), ps[-1])
    return high - _quantile(own("all"), ps[0]) if len(ps) == 2 else high


# ---------------------------------------------------------------- spectra of windows


def window_band_peaks(
    rows: DataFrame,
    column: str,
    by: Sequence[str],
    length: int,
    step: int,
    fs: float,
    bands: Mapping[str, tuple[float, float, float]],
    idx: str = "idx",
    anchor: str = "_zero",
    end: str = "_total",
    min_rows: int = 4,
) -> DataFrame:
    """Strongest frequency (per minute) of each band ``{name: (low, high, step)}`` in every window of samples.

    The spectrum is that of :func:`periodogram` with a Hann taper over the window.  The samples themselves travel to
    the stretch of their windows (the Fourier sums of a pane are many times as large), where a task multiplies the
    tapered, mean-free windows of many stretches with the waves of all frequencies.
    """
    by = list(by)
    grid = sorted({f for low, high, width in bands.values() for f in frequency_grid(low, high, width)})
    y, at = finite(column), (F.col(idx) - F.col(anchor)).cast("bigint")
    inside = _in_windows(rows.select(*by, idx, anchor, end, column), length, step, 1, idx, anchor, end).where(y.isNotNull())
    windows = (F.floor((F.col(end) - F.col(anchor) - F.lit(length)) / F.lit(step)) + 1).cast("bigint")
    sampled = inside.select(*by, anchor, end, at.alias("_pane"), y.alias("_y"), windows.alias("_windows"))
    keys = [*by, "_stretch"]
    placed = _stretched(sampled, by, length, step, 1, anchor, end).select(*keys, "_pane", "_y", "_windows").sortWithinPartitions(*keys, "_pane")
    per_stretch = windows_per_stretch(length, step)
    room = (per_stretch - 1) * step + length
    angle = 2 * math.pi / fs * np.arange(length)[:, None] * np.array(grid)[None, :]
    cosines, sines, taper = np.cos(angle), np.sin(angle), 0.5 - 0.5 * np.cos(2 * math.pi * np.arange(length) / length)
    columns = {name: [grid.index(f) for f in frequency_grid(*band)] for name, band in bands.items()}

    def strongest(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        """Of all windows of some whole stretches, whose first rows are ``starts``."""
        first = table["_stretch"].to_numpy()[starts] * per_stretch
        held = np.minimum(table["_windows"].to_numpy()[starts] - first, per_stretch)
        own = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(table))))
        cell, value = table["_pane"].to_numpy() - first[own] * step, table["_y"].to_numpy()
        wins, series, found = [], [], {name: [] for name in bands}
        some = max(1, VALUES // room)
        for a in range(0, len(starts), some):
            z = min(a + some, len(starts))
            mine = slice(*np.searchsorted(own, [a, z]))
            here = (own[mine] - a) * room + cell[mine]
            total, count = np.bincount(here, value[mine], (z - a) * room), np.bincount(here, minlength=(z - a) * room)
            group = np.repeat(np.arange(a, z), held[a:z])
            win = np.arange(len(group)) - np.repeat(np.cumsum(held[a:z]) - held[a:z], held[a:z])
            begin = (group - a) * room + win * step
            for i in range(0, len(begin), max(1, VALUES // length)):
                part = slice(i, i + max(1, VALUES // length))
                cells = begin[part, None] + np.arange(length)
                v, c = total[cells], count[cells]
                n = c.sum(axis=1)
                v, c, kept, n = v[n > 0], c[n > 0], np.flatnonzero(n > 0) + i, n[n > 0]
                tapered = (v - c * (v.sum(axis=1) / n)[:, None]) * taper
                power = ((tapered @ cosines) ** 2 + (tapered @ sines) ** 2) / n[:, None]
                series.append(starts[group[kept]])
                wins.append(first[group[kept]] + win[kept])
                for name, band in columns.items():
                    best = power[:, band].argmax(axis=1) if len(n) else np.zeros(0, int)
                    known = (n >= min_rows) & (power[np.arange(len(n)), np.array(band)[best]] > 0)
                    found[name].append(pa.array(np.array(grid)[np.array(band)[best]] * 60.0, mask=~known))
        whole = table.select(by).take(pa.array(np.concatenate(series))).combine_chunks()
        columns_out = [*(x.combine_chunks() for x in whole.columns), pa.array(np.concatenate(wins)), *(pa.concat_arrays(found[name]) for name in bands)]
        return pa.RecordBatch.from_arrays(columns_out, [*by, "win", *bands])

    def spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            if not len(table):
                continue
            starts = _starts(table, keys)
            rest = table.slice(starts[-1])  # the last stretch may go on in the next batch
            if len(starts) > 1:
                yield strongest(table.slice(0, starts[-1]).combine_chunks(), starts[:-1])
        if rest is not None:
            yield strongest(rest.combine_chunks(), np.zeros(1, np.int64))

    schema = T.StructType([*(placed.schema[c] for c in by), T.StructField("win", T.LongType()), *(T.StructField(name, T.DoubleType()) for name in bands)])
    return placed.mapInArrow(spectra, schema)


__all__ = ["window_band_peaks", "window_stats", "windows_per_stretch"]

"""Stratified folds against a plain walk over all groups."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from physio_spark.operators import splits


def plain_walk(vectors, k):
    """Fold (from 1) of every group id of a dict of class counts, one group after the other."""
    c = len(next(iter(vectors.values())))
    totals = [max(1, sum(v[i] for v in vectors.values())) for i in range(c)]
    uneven = lambda v: c * sum(x * x for x in v) - sum(v) ** 2
    held = [[0] * c for _ in range(k)]
    out = {}
    for g, v in sorted(vectors.items(), key=lambda x: (-uneven(x[1]), -sum(x[1]), x[1], x[0])):
        costs = []
        for f in range(k):
            spread = 0.0
            for i in range(c):
                shares = [(held[j][i] - min(h[i] for h in held) + (v[i] if j == f else 0)) / totals[i] for j in range(k)]
                mean = sum(shares) / k
                spread += math.sqrt(sum((s - mean) ** 2 for s in shares) / k)
            load = sum((held[f][i] - min(h[i] for h in held)) / totals[i] for i in range(c))
            costs.append((round(spread / c, 12), round(load, 12), f))
        f = min(costs)[2]
        held[f] = [a + b for a, b in zip(held[f], v, strict=True)]
        out[g] = f + 1
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 4), min_size=3, max_size=3), st.integers(1, 40)), min_size=1, max_size=6), st.integers(2, 5))
def test_cycles_deal_like_single_steps(kinds, k):
    totals = [max(1, sum(v[i] * n for v, n in kinds)) for i in range(3)]
    whole, single = splits.EvenWalk(k, totals), splits.EvenWalk(k, totals)
    for v, n in kinds:
        runs = whole.deal(v, n)
        ranks = [None] * n
        for at, size, folds in runs:
            for r in range(at, at + size):
                assert ranks[r] is None
                ranks[r] = folds[(r - at) % len(folds)]
        assert ranks == [single.deal(v, 1)[0][2][0] for _ in range(n)]
        assert (whole.held == single.held).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_folds_are_those_of_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    rows = [(g, rng.choice("aabc")) for g in range(60) for _ in range(rng.choice([1, 1, 2, 3, 9]))] + [(70, None), (71, None), (3, None)]
    df = spark.createDataFrame(rows, "subject int, label string").repartition(7)
    got = {r["subject"]: r["fold"] for r in splits.fold_table(df, "subject", 4, stratify="label").collect()}
    vectors = {g: [sum(1 for x, y in rows if x == g and y == c) for c in "abc"] for g, _ in rows}
    assert got == plain_walk(vectors, 4)


def test_a_million_equal_groups_are_dealt_in_many_tasks(spark):
    df = spark.range(1_000_000).selectExpr("id as subject", "if(id % 3 = 0, 'a', 'b') as label")
    table = splits.fold_table(df, "subject", 5, stratify="label")
    counts = {(r["fold"], r["a"]): r["n"] for r in table.selectExpr("fold", "subject % 3 = 0 as a").groupBy("fold", "a").count().withColumnRenamed("count", "n").collect()}
    for a, total in ((True, 333_334), (False, 666_666)):
        assert sum(counts[f, a] for f in range(1, 6)) == total
        assert max(counts[f, a] for f in range(1, 6)) - min(counts[f, a] for f in range(1, 6)) <= 1

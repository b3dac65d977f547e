"""One rule at every size, null keys, gaps, odd files."""

import heapq
import random

import numpy as np
import pytest

from physio_spark.operators import balance, evaluate, models, ordered, signal, splits
from physio_spark.sources import readers


def greedy(sizes, k):
    loads, out = [(0, f) for f in range(1, k + 1)], {}
    for n, g in sorted((-n, g) for g, n in sizes.items()):
        load, f = heapq.heappop(loads)
        out[g] = f
        heapq.heappush(loads, (load - n, f))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_greedy_folds_match_the_walk(spark, seed):
    rng = random.Random(seed)
    sizes = {g: rng.choice([1, 1, 1, 2, 3, 7, rng.randrange(1, 60)]) for g in range(150)}
    rows = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "subject int").repartition(5)
    got = {r["subject"]: r["fold"] for r in splits.fold_table(rows, k=4).collect()}
    assert got == greedy(sizes, 4)


def test_ranks_of_equal_groups():
    loads, n = np.array([5, 0, 17, 3]), 4
    heap, want = [(int(x), f) for f, x in enumerate(loads)], []
    heapq.heapify(heap)
    for _ in range(40):
        load, f = heapq.heappop(heap)
        want.append(f)
        heapq.heappush(heap, (load + n, f))
    assert splits._ranks(loads, n, np.arange(40)).tolist() == want
    assert splits._given(loads, n, 33).tolist() == np.bincount(want[:33], minlength=4).tolist()


def test_folds_refuse_what_they_cannot_do(spark):
    rows = spark.createDataFrame([(1, "a"), (None, "b")], "subject int, label string")
    with pytest.raises(Exception, match="no subject"):
        splits.group_kfold(rows, k=2).collect()
    with pytest.raises(ValueError, match="snake"):
        splits.group_kfold(rows, k=2, stratify="label", method="snake")


def test_members_of_folds(spark):
    rows = spark.createDataFrame([(g, 1 + g % 2) for g in (1, 2, 3)], "subject int, fold int")
    got = {(r["fold"], r["role"], r["subject"]) for r in splits.fold_members(rows).collect()}
    assert got == {(1, "val", 2), (1, "train", 1), (1, "train", 3), (2, "val", 1), (2, "val", 3), (2, "train", 2)}


def test_null_keys_stay(spark):
    rows = spark.createDataFrame([(None, 1, 1.0), (None, 2, 3.0), ("a", 1, 5.0)], "s string, idx long, v double")
    scanned = ordered.scan(rows, ["s"], ["idx"], 1, prev={"p": rows["v"]})
    assert {(r["s"], r["idx"], r["p"]) for r in scanned.collect()} == {(None, 1, None), (None, 2, 1.0), ("a", 1, None)}
    means = rows.groupBy("s").agg({"v": "avg"})
    for salts in (1, 4):
        assert ordered.attach(rows, means, ["s"], salts).count() == 3
    placed = ordered.ranked(rows, ["s"], [rows["idx"]], "r", rows["idx"])
    assert {(r["s"], r["idx"], r["r"]) for r in placed.collect()} == {(None, 1, 1), (None, 2, 2), ("a", 1, 1)}


@pytest.mark.parametrize("chunk", [4, 100_000])
def test_rolling_mean_over_gaps(spark, chunk):
    nan = float("nan")
    values = [10.0, None, 10.0, nan, None, None, 4.0, 6.0, 8.0, None]
    rows = spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], "s int, idx long, v double")
    got = [r["m"] for r in signal.rolling_mean(rows, "v", 3, ["s"], out="m", chunk=chunk).orderBy("idx").collect()]
    full = []
    for k in range(1, len(values) - 1):
        there = [v for v in values[k - 1 : k + 2] if v is not None and v == v]
        full.append(sum(there) / len(there) if there else None)
    assert got == pytest.approx([full[0], *full, full[-1]])


def test_files_with_odd_lines(spark, tmp_path):
    head = "daqtime,ecg,video\n"
    (tmp_path / "sub_123.csv").write_text(head + "0,1.0,1\n1\n2,1,2,9\n")
    (tmp_path / "sub_23.csv").write_text(head + '5,2.0,"1"\n')
    got = readers.read_samples(spark, str(tmp_path)).collect()
    assert sorted((r["subject"], r["t"], r["ecg"]) for r in got if r["ecg"]) == [(23, 5000, 2.0), (123, 0, 1.0)]
    assert [(r["subject"], r["t"]) for r in got if r["ecg"] is None] == [(123, 1000)]
    assert readers.read_samples(spark, str(tmp_path), bad_lines="keep").count() == 4
    with pytest.raises(Exception, match="too many fields"):
        readers.read_samples(spark, str(tmp_path), bad_lines="fail").collect()
    (tmp_path / "sub_9.csv").write_text("video,ecg,daqtime\n1,2.0,7\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_samples(spark, str(tmp_path)).collect()


def test_depth_beyond_the_limit_is_refused():
    with pytest.raises(ValueError, match="30"):
        models.forest(depth=40)


def test_rows_without_a_label_are_refused(spark):
    rows = spark.createDataFrame([("a", "a"), ("b", None)], "true_label string, pred_label string")
    with pytest.raises(Exception, match="no pred_label"):
        evaluate.confusion_matrix(rows).collect()


def test_copies_of_few_seeds_are_born_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(balance, "COPIES_PER_ROW", 50)
    rows = [(k, "big", float(k), 0.0) for k in range(900)] + [(1000, "few", 1.0, 5.0), (1001, "few", 2.0, 6.0)]
    out = balance.smote(spark.createDataFrame(rows, "window_id long, label string, a double, b double"), ["a", "b"])
    made = out.where("synthetic").toPandas()
    assert len(made) == 898 and set(made["label"]) == {"few"}
    assert made["a"].between(1, 2).all() and np.allclose(made["b"], made["a"] + 4)
    assert made[["a"]].drop_duplicates().shape[0] > 800


def test_tallest_first_streams_its_chunks(spark, monkeypatch):
    """Many short series, one of them without a key: no call for each chunk, same choice as by brute force."""
    from physio_spark.operators import signal as G

    rng = random.Random(5)
    rows = []
    for subject in [None, *range(40)]:
        at = sorted(rng.sample(range(300), 60)) if subject != 7 else list(range(0, 300, 2))
        rows += [(subject, i, float(i) if subject == 7 else float(rng.randrange(9))) for i in at]
    rows.append((3, 301, float("nan")))
    plans = []
    write = G.materialize

    def noted(df, *more):
        plans.append(df._jdf.queryExecution().toString())
        return write(df, *more)

    monkeypatch.setattr(G, "materialize", noted)
    d = spark.createDataFrame(rows, "subject int, idx long, value double").repartition(5)
    got = sorted(((-1 if r[0] is None else r[0]), r[1]) for r in G.tallest_first(d, ["subject"], "idx", "value", 5, chunk=50).select("subject", "idx").collect())
    want = [(3, 301)]
    for subject in [None, *range(40)]:
        kept = []
        for _, i in sorted(((v, i) for s, i, v in rows if s == subject and v == v), reverse=True):
            if all(abs(i - k) >= 5 for k in kept):
                kept.append(i)
        want += [(-1 if subject is None else subject, i) for i in kept]
    assert got == sorted(want)
    assert plans and not any("FlatMapGroupsInPandas" in p for p in plans)


def test_a_folder_of_recordings_is_listed_once(spark, tmp_path):
    """The header is the first line that is not blank; no job visits the files as paths of their own."""
    for k in range(40):
        (tmp_path / f"sub_{k}.csv").write_text('\n"daqtime",ECG,video\n' + f"{k}.5,{k},3\n")
    (tmp_path / "sub_99.csv").write_text("")
    sc = spark.sparkContext
    sc.setJobGroup("one-listing", "")
    try:
        read = readers.read_samples(spark, str(tmp_path))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    track = sc.statusTracker()
    stages = [s for j in track.getJobIdsForGroup("one-listing") for s in track.getJobInfo(j).stageIds]
    tasks = [i.numTasks for s in stages if (i := track.getStageInfo(s))]
    assert tasks and max(tasks) < 40
    assert sorted(tuple(r) for r in read.select("subject", "t", "video", "ecg").collect()) == [(k, k * 1000 + 500, 3, float(k)) for k in range(40)]

"""Readers and writers, streams in several micro-batches, and models on small tables."""

import gzip
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from physio_spark.operators import balance, models, splits
from physio_spark.operators.evaluate import classification_metrics, running_vote
from physio_spark.operators.features import FeatureConfig, window_features
from physio_spark.runtime import checkpoint_dir, materialize
from physio_spark.sources import readers, writers
from physio_spark.streaming import jobs

# ---------------------------------------------------------------- files


def test_samples_from_many_files(spark, tmp_path):
    head = "daqtime,ecg,PPG,eda,video\n"
    (tmp_path / "sub_1.csv").write_text(head + "0,1.0,2.0,3.0,1\n1.5,oops,2.5,nan,1\n")
    (tmp_path / "sub_12.csv").write_text(head + "0,1.0,2.0,3.0,2\n1,1\n2,1,2,3,4,5,6\n3,9,9,9,2\n")
    got = readers.read_samples(spark, str(tmp_path)).toPandas().sort_values(["subject", "t"])
    assert got["subject"].unique().tolist() == [1, 12]
    assert got["t"].tolist()[:2] == [0, 1500]
    assert {"ecg", "bvp", "gsr", "video", "time_s"} <= set(got.columns) and "rsp" not in got.columns
    assert np.isnan(got["ecg"].iloc[1]) and np.isnan(got["gsr"].iloc[1])
    assert (got["subject"] == 12).sum() == 3  # the line that is too long is dropped, the short one stays
    some = readers.read_samples(spark, str(tmp_path), subjects=[12, 30])
    assert some.select("subject").distinct().count() == 1
    assert readers.missing_subjects(some, [12, 30]) == [30]
    with pytest.raises(ValueError, match="missing columns"):
        readers.read_samples(spark, str(tmp_path), channels=["rsp"])


def test_annotations_and_fuzzy_names(spark, tmp_path):
    (tmp_path / "sub_3.csv").write_text("jstime,valence,arousal\n0,5,5\n50,5.5,4.5\n")
    got = readers.read_annotations(spark, str(tmp_path)).orderBy("t").collect()
    assert [(r["subject"], r["t"], r["valence"]) for r in got] == [(3, 0, 5.0), (3, 50000, 5.5)]
    assert readers.find_column(["Skin_Temp", "x"], ("skt", "*temp*")) == "Skin_Temp"
    assert readers.find_column(["a"], ("b", "*c*")) is None


def test_videos_with_trailing_tab(spark, tmp_path):
    path = tmp_path / "d.txt"
    path.write_text('"video_name"\t"video_duration"\n"first-1"\t185583.333\n"pause"\t120000\t\n"last"\t101500\n')
    got = {r["video_name"]: r["video_duration"] for r in readers.read_videos(spark, str(path)).collect()}
    assert got == {"first-1": 185583.333, "pause": 120000.0, "last": 101500.0}


def test_feature_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.0, 4.0, 0.5), (2, 1.0, 5.0, 0.7)], "subject int, start_s double, label_valence double, gsr_mean double")
    writers.write_features(df, str(tmp_path / "out"), partition_by="subject")
    back = readers.read_features(spark, str(tmp_path / "out" / "combined")).select(df.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    parts = {n: spark.read.parquet(str(tmp_path / "out" / n)) for n in ("X", "meta", "y_label_valence")}
    assert {n: p.columns for n, p in parts.items()} == {"X": ["row", "gsr_mean"], "meta": ["row", "subject", "start_s"], "y_label_valence": ["row", "label_valence"]}
    whole = parts["meta"].join(parts["X"], "row").join(parts["y_label_valence"], "row").select(df.columns)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, df.collect()))
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "X_csv")).columns == ["row", "gsr_mean"]
    with gzip.open(tmp_path / "f.csv.gz", "wt") as f:
        f.write("subject,gsr_mean\n1,0.5\n")
    assert readers.read_features(spark, str(tmp_path / "f.csv.gz")).dtypes == [("subject", "int"), ("gsr_mean", "double")]


def test_metrics_sink_keeps_nested_columns(spark, tmp_path):
    df = spark.sql("select 1 as subject, map('a', 0.5D, 'b', 0.5D) as prob")
    writers.write_metrics({"votes": df}, str(tmp_path))
    back = spark.read.schema("subject int, prob map<string,double>").json(str(tmp_path / "votes_json")).first()
    assert back["prob"] == {"a": 0.5, "b": 0.5}
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "votes_csv")).count() == 1


def test_intermediate_tables_use_the_configured_folder(spark):
    def session(folder, master):
        conf = SimpleNamespace(get=lambda key, default: folder if key == "spark.checkpoint.dir" else default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))

    assert checkpoint_dir(session("hdfs:///shared/", "yarn")) == "hdfs:///shared"
    with pytest.raises(ValueError, match="shared folder"):
        checkpoint_dir(session(None, "yarn"))
    assert checkpoint_dir(session(None, "local[2]"))
    assert materialize(spark.range(5)).count() == 5


# ---------------------------------------------------------------- streams


def drain(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return q


def feed(spark, tmp_path, pdf, schema, per_file):
    for i in range(0, len(pdf), per_file):
        spark.createDataFrame(pdf.iloc[i : i + per_file], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def ticks(n=120):
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) * 10, unit="s")
    return pd.DataFrame({"subject": np.arange(n) % 2, "ts": ts, "value": np.arange(n, dtype=float)})


def test_window_stream_equals_batch(spark, tmp_path):
    schema = "subject bigint, ts timestamp, value double"
    pdf = ticks()
    stream = jobs.window_stats_stream(feed(spark, tmp_path, pdf, schema, 40), "60 seconds", "30 seconds", late="1 minute")
    drain(stream, "w_stream", "complete")
    got = spark.table("w_stream").toPandas().sort_values(["subject", "win_start"], ignore_index=True)
    want = jobs.window_stats_stream(spark.createDataFrame(pdf, schema), "60 seconds", "30 seconds").toPandas()
    pd.testing.assert_frame_equal(got, want.sort_values(["subject", "win_start"], ignore_index=True))


def test_late_row_is_dropped(spark, tmp_path):
    schema = "subject bigint, ts timestamp, value double"
    pdf = ticks(60)
    late = pd.DataFrame({"subject": [0], "ts": [pd.Timestamp("2024-01-01")], "value": [1e9]})
    for part in (pdf, pd.DataFrame({"subject": [0], "ts": [pd.Timestamp("2024-01-01 02:00")], "value": [0.0]}), late):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(jobs.window_stats_stream(source, "60 seconds", "60 seconds", late="1 minute"), "late_stream", "append")
    assert spark.table("late_stream").agg(F.max("max")).first()[0] < 1e9


def test_session_stream_equals_gaps(spark, tmp_path):
    schema = "subject bigint, video bigint, ts timestamp"
    base = pd.Timestamp("2024-01-01")
    seconds = [0, 5, 9, 40, 44, 90, 500]
    pdf = pd.DataFrame({"subject": 1, "video": 2, "ts": [base + pd.Timedelta(seconds=s) for s in seconds]})
    stream = jobs.session_stream(feed(spark, tmp_path, pdf, schema, 3), "20 seconds", late="30 seconds")
    drain(stream, "s_stream", "append")
    got = spark.table("s_stream").orderBy("start").toPandas()
    assert got["n"].tolist()[:3] == [3, 2, 1]  # the last block is still open


def test_vote_stream_ends_like_the_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    n = 90
    pdf = pd.DataFrame({
        "subject": rng.integers(0, 3, n), "video": rng.integers(1, 3, n), "pos": range(n),
        "true_label": "a", "pred_label": rng.choice(["a", "b"], n),
    })
    schema = "subject bigint, video bigint, pos bigint, true_label string, pred_label string"
    drain(jobs.running_vote_stream(feed(spark, tmp_path, pdf, schema, 30)), "v_stream", "update")
    last = spark.table("v_stream").groupBy("subject", "video").agg(F.max("n_seen").alias("n_seen"), F.max("votes").alias("votes"))
    batch = running_vote(spark.createDataFrame(pdf, schema), order=["pos"], width=10)
    want = batch.groupBy("subject", "video").agg(F.max("n_seen").alias("n_seen"), F.max("votes").alias("votes"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


# ---------------------------------------------------------------- models


def blobs(n=240, seed=0, sizes=(0.5, 0.35, 0.15)):
    rng = np.random.default_rng(seed)
    label = rng.choice(3, n, p=sizes)
    x = rng.normal(size=(n, 4)) + np.eye(3, 4)[label] * 4
    pdf = pd.DataFrame(x, columns=list("pqrs"))
    return pdf.assign(window_id=range(n), subject=rng.integers(0, 12, n), label=[f"c{v}" for v in label])


def test_out_of_fold_predictions(spark):
    df = splits.group_kfold(spark.createDataFrame(blobs()), "subject", 3)
    oof = materialize(models.oof_classify(df, models.forest(10, 5), list("pqrs"), keep=["window_id", "subject"]))
    assert oof.count() == 240 and oof.select("window_id").distinct().count() == 240
    assert oof.groupBy("subject").agg(F.count_distinct("fold").alias("n")).agg(F.max("n")).first()[0] == 1
    total = oof.select(sum(F.col(f"proba_c{i}") for i in range(3)).alias("t")).agg(F.max(F.abs(F.col("t") - 1))).first()[0]
    assert total < 1e-9
    assert classification_metrics(oof).first()["accuracy"] > 0.85


def test_regression_fills_and_predicts(spark):
    pdf = blobs().assign(arousal=lambda d: d["p"] * 2 - d["q"], valence=np.nan)
    df = splits.group_kfold(spark.createDataFrame(pdf), "subject", 3)
    out = models.oof_regress(df, ["arousal"], list("pqrs"), "linear").toPandas()
    assert np.corrcoef(out["arousal"], out["pred_arousal"])[0, 1] > 0.99
    assert set("pqrs") <= set(out.columns) and out["p"].sum() == pytest.approx(pdf["p"].sum())


def test_selection_and_importance(spark):
    df = materialize(spark.createDataFrame(blobs()))
    assert len(models.rfe(df, models.forest(5, 4), list("pqrs"), 2)) == 2
    model = models.refit(df, models.forest(10, 5), list("pqrs"))
    table = {r["feature"]: r["importance_mean"] for r in models.permutation_importance(df, model, list("ps"), repeats=2).collect()}
    assert table["p"] > table["s"]


def test_saved_model_scores_held_out_subjects(spark, tmp_path):
    df = spark.createDataFrame(blobs())
    models.refit(df, models.forest(5, 4), list("pqrs")).save(str(tmp_path / "model"))
    got = models.score(df, str(tmp_path / "model"), [1, 2], keep=["subject"])
    assert {r["subject"] for r in got.select("subject").distinct().collect()} == {1, 2}


def test_consensus_prefers_votes_then_score():
    a, b = {"depth": 2}, {"depth": 3}
    chosen = [{"setting": a, "f1_macro": 0.1}, {"setting": b, "f1_macro": 0.9}, {"setting": a, "f1_macro": 0.2}]
    assert models.consensus(chosen) == a
    assert models.consensus(chosen[:2]) == b
    assert len(models.sample_space({"x": [1, 2], "y": [1, 2]}, 10)) == 4


@pytest.mark.parametrize("tile", [25, 4000])
def test_neighbours_equal_brute_force(spark, tile):
    pdf = blobs(150, 3)
    x = pdf[list("pqrs")].to_numpy()
    df = spark.createDataFrame(pdf).select("window_id", F.array(*"pqrs").alias("v"))
    got = balance.nearest_neighbours(df, df, "window_id", "v", 3, tile=tile).toPandas().sort_values(["window_id", "rank"])
    dist = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(dist, np.inf)
    np.testing.assert_array_equal(got["neighbour"].to_numpy().reshape(-1, 3), np.argsort(dist, 1)[:, :3])


def test_neighbours_of_copies_are_the_smallest_keys(spark):
    df = spark.range(600).select(F.col("id").alias("window_id"), F.array((F.col("id") % 2).cast("double"), F.lit(0.5)).alias("v"))
    found = balance.nearest_neighbours(df, df, "window_id", "v", 3, tile=1)
    got = {(r["window_id"], r["rank"]): r["neighbour"] for r in found.collect()}
    for i in range(600):
        assert [got[i, r] for r in (1, 2, 3)] == [j for j in range(i % 2, 10, 2) if j != i][:3]


def test_smote_fills_the_minority_between_neighbours(spark):
    pdf = blobs(200, 5)
    out = balance.smote(spark.createDataFrame(pdf), list("pqrs")).toPandas()
    assert out.groupby("label").size().nunique() == 1
    assert (~out["synthetic"]).sum() == 200
    for label, made in out[out["synthetic"]].groupby("label"):
        real = pdf.loc[pdf["label"] == label, list("pqrs")]
        assert (made[list("pqrs")] <= real.max() + 1e-9).all().all() and (made[list("pqrs")] >= real.min() - 1e-9).all().all()
    lonely = pdf[pdf["label"] == "c0"]
    assert balance.smote(spark.createDataFrame(lonely), list("pqrs")).count() == len(lonely)


# ---------------------------------------------------------------- whole feature rows


def test_window_features_of_a_regular_pulse(spark):
    fs, seconds = 50, 60
    t = np.arange(fs * seconds)
    pulse = (t % 40 == 20).astype(float)  # a beat every 0.8 s
    pdf = pd.DataFrame({"subject": 1, "t": t * 20_000, "video": np.where(t < len(t) // 2, 1, 2), "bvp": pulse + t * 1e-9})
    notes = pd.DataFrame({"subject": 1, "t": [0, int(60e6)], "valence": [4.0, 6.0], "arousal": [5.0, 5.0]})
    config = FeatureConfig(10_000_000, 5_000_000, fs, "bvp", ["bvp"])
    got = window_features(spark.createDataFrame(pdf), spark.createDataFrame(notes), config, width=7_000_000).toPandas()
    assert len(got) == 2 * 4  # each 30 s block ends one sample early, so its last window does not fit
    assert got["bpm"].to_numpy() == pytest.approx(75.0)
    assert got["n_rows"].unique().tolist() == [500]
    assert got["label_arousal"].to_numpy() == pytest.approx(5.0)


def test_votes_live_for_their_time_and_no_longer(spark):
    from physio_spark.streaming.replay import LiveTable

    schema = "subject bigint, video bigint, true_label string, pred_label string, ts timestamp"
    at = lambda s: (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)).to_pydatetime()
    arrive = lambda live, *rows: live.arrive(spark.createDataFrame([(*r[:4], at(r[4])) for r in rows], schema))
    live = LiveTable(spark, lambda d: jobs.running_vote_stream(d, ts="ts", ttl_s=100.0, late="10 seconds", closing=True))
    arrive(live, (1, 1, "a", "a", 0), (1, 1, "a", "b", 50), (2, 1, "a", "a", 60))
    assert live.advance() == 0
    assert live.results().count() == 0  # all are still open
    again = LiveTable(spark, live.build, live.folder)  # another session: the checkpoint holds the counters
    arrive(again, (1, 1, "a", "a", 140), (3, 1, "a", "b", 150))
    again.advance()
    arrive(again, (None, None, None, None, 200))
    again.advance()
    assert [tuple(r) for r in again.results().collect()] == [(2, 1, 1, 1, 1.0)]  # nothing came for 100 seconds
    arrive(again, (1, 1, "a", "a", 230), (None, None, None, None, 10_000))
    again.advance()
    got = sorted(tuple(r) for r in again.results().collect())
    assert got == [(1, 1, 3, 4, 0.75), (2, 1, 1, 1, 1.0), (3, 1, 0, 1, 0.0)]
    with pytest.raises(ValueError, match="event time"):
        jobs.running_vote_stream(again.results(), closing=True)


def test_closing_votes_call_no_function_for_a_stimulus(spark):
    schema = "subject bigint, video bigint, true_label string, pred_label string, ts timestamp"
    at = lambda s: (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)).to_pydatetime()
    rows = [(1, 1, "a", "a", at(0)), (1, 1, None, "b", at(90)), (1, 1, "a", "a", at(500)), (None, 1, "a", "a", at(0))]
    got = jobs.running_vote_stream(spark.createDataFrame(rows, schema), ts="ts", ttl_s=100.0, closing=True)
    assert "Pandas" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1, 1, 1.0), (1, 1, 1, 2, 0.5)]  # a stimulus that comes back begins anew


def test_rows_behind_the_watermark_are_counted(spark):
    from physio_spark.streaming.replay import LiveTable, replay

    pdf = ticks(60)
    schema = "subject bigint, ts timestamp, value double"
    build = lambda d: jobs.window_stats_stream(d, "60 seconds", "60 seconds", late="1 minute")
    live = LiveTable(spark, build)
    live.arrive(spark.createDataFrame(pdf, schema))
    assert live.advance() == 0
    live.arrive(spark.createDataFrame(pdf.head(3), schema))
    assert 1 <= live.advance() <= 3  # one for each group that a task has summed up before
    whole = replay(spark.createDataFrame(pdf, schema), "ts", build, "1 hour")
    assert whole.agg(F.sum("n")).first()[0] == 60


def test_regression_folds_are_fitted_side_by_side(spark, monkeypatch):
    calls, whole = [], models.concurrently
    monkeypatch.setattr(models, "concurrently", lambda s, c: calls.append(len(c)) or whole(s, c))
    df = spark.createDataFrame([(i, i % 3, float(i % 7), float(i % 5), float(i)) for i in range(60)], "window_id int, fold int, a double, b double, y double")
    got = models.oof_regress(df, ["y"], ["a", "b"], "forest", trees=3).toPandas()
    assert calls == [3]
    assert len(got) == 60 and got["pred_y"].notna().all() and set(got["a"]) == set(map(float, range(7)))

"""Language identification and toxicity: exact code lengths, held-out accuracy, edge cases."""

import math
import pathlib

import numpy as np
import pyarrow as pa
import pytest

from physio_spark.llm import language_id, queries, toxicity

SF = "/root/testdata/sf0.001"


def trees(spark, rows):
    frame = spark.createDataFrame(rows, "k long, t string, l string")
    return language_id.fit(frame, "k", "t", "l")


def bits_by_hand(texts, body):
    """Escape method C over contexts of 3, 2, 1 and 0 bytes, straight from the counts."""
    pad = b"\n" * 3
    grams = {}
    for t in texts:
        data = pad + t.encode()
        for k in range(3, len(data)):
            for n in range(4):
                grams.setdefault(data[k - n : k], {}).setdefault(data[k], 0)
                grams[data[k - n : k]][data[k]] += 1
    deep = {c for c, s in grams.items() if len(c) == 3 and sum(s.values()) >= language_id.LEAST_CONTEXT}
    total, data = 0.0, pad + body.encode()
    for k in range(3, len(data)):
        p = 1.0
        for n in (3, 2, 1, 0):
            context = data[k - n : k]
            if n == 3 and context not in deep or context not in grams:
                continue
            seen = grams[context]
            size = sum(seen.values()) + len(seen)
            if data[k] in seen:
                p *= seen[data[k]] / size
                break
            p *= len(seen) / size
        else:
            p /= 256
        total -= math.log2(p)
    return total


def test_code_lengths_are_exact(spark):
    texts = ["the cat sat on the mat and the cat sat", "a cat is a cat", "ünd ß"]
    coder = language_id.Coder(trees(spark, [(k, t, "en") for k, t in enumerate(texts)]))
    asked = ["the cat", "zebra", "", "ß und ☃", "the cat sat on the mat" * 50]
    found = coder.score(pa.array(asked))
    assert np.allclose(found[:, 0], [bits_by_hand(texts, t) for t in asked], rtol=1e-4)


def test_long_texts_are_scored_across_chunks(spark, monkeypatch):
    model = trees(spark, [(1, "abc abd abe " * 20, "x"), (2, "xyz xyw " * 20, "y")])
    asked = pa.array(["abc xyz " * 100, "", "abd", None, "xyw " * 33])
    whole = language_id.Coder(model).score(asked)
    monkeypatch.setattr(language_id, "CHUNK", 7)
    assert np.allclose(language_id.Coder(model).score(asked), whole)


def test_languages_of_odd_rows(spark):
    model = trees(spark, [(1, "the and of to", "en"), (2, "le la et de", "fr"), (3, None, "de"), (4, "x", None), (None, "q", "zz")])
    assert model.langs == ["en", "fr"]
    rows = [(1, "the and"), (1, "the and"), (2, None), (3, ""), (4, "12 !?"), (None, "et la de le"), (5, "et de " * 100_000)]
    docs = spark.createDataFrame([(i, t, "keep", 0.5) for i, t in rows], "doc_id long, text string, lang_pred string, score double")
    found = sorted(((r["doc_id"], r["lang_pred"]) for r in language_id.identify(docs, model).collect()), key=str)
    assert found == sorted([(1, "en"), (1, "en"), (2, "und"), (3, "und"), (4, "und"), (None, "fr"), (5, "fr")], key=str)
    kept = language_id.keep_identified(docs, model)
    assert kept.schema == docs.schema and kept.count() == 4
    assert language_id.identify(docs.where("doc_id > 9"), model).count() == 0
    nothing = language_id.fit(spark.createDataFrame([], "k long, t string, l string"), "k", "t", "l")
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_fit_takes_about_the_bound(spark):
    rows = [(k, f"text number {k}", "en") for k in range(2000)]
    frame = spark.createDataFrame(rows, "k long, t string, l string")
    all_, some = (language_id.fit(frame, "k", "t", "l", per_language=n) for n in (5000, 200))
    assert 0.05 < some.counts[0].sum() / all_.counts[0].sum() < 0.15


def test_held_out_languages(spark):
    found = queries.op5_language_id(spark, SF).where("held_out").toPandas()
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    assert len(found) and language_id.accuracy(found, truth) > 0.95


@pytest.mark.parametrize(
    ("text", "folded"),
    [
        ("You IDIOT!", " you idiot "),
        ("id10t 1diot stup1d", " idiot idiot stupid "),
        ("іdіоt", " idiot "),
        ("ｉｄｉｏｔ", " idiot "),
        ("i​diot", " idiot "),
        ("a$$hat l0ser$$$ 100 % s@d", " asshat loser sad "),
        ("élève Straße", " élève straße "),
        ("", " "),
        ("... 12 --", " "),
    ],
)
def test_folding(text, folded):
    assert toxicity.fold(text) == folded


def test_longest_entry_and_exceptions():
    lexicon = toxicity.Lexicon({" scum ": 5.0, " scu": 2.0, " trash ": 4.0}, {" trash can "})
    auto = lexicon.automaton()
    found = lambda t: sorted(w for _, w in toxicity.hits(toxicity.fold(t), auto).values())
    assert found("scum scumbag") == [2.0, 5.0]
    assert found("the trash can is full of trash") == [4.0]
    assert found("obscum") == []


def test_toxicity_learns_words_phrases_and_curve(spark):
    rows = []
    for k in range(400):
        bad = k % 4 == 0
        words = [f"plain{(k * 7 + j) % 50}" for j in range(20)]
        rows.append((k, " ".join(words + (["vile", f"scoff{k % 9}"] if bad else ["vile", "weather"] if k % 4 == 1 and k % 8 == 1 else [])), int(bad)))
    frame = spark.createDataFrame(rows, "k long, t string, y int")
    lexicon = toxicity.fit(frame, "k", "t", "y")
    assert " scoff" in lexicon.weights
    docs = spark.createDataFrame([(1, "plain1 plain2 sc0ff3 plain4 plain5"), (2, "plain1 plain2"), (3, None), (4, ""), (None, "scoff1 scoff2"), (5, "plain3 " * 50_000)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in toxicity.score(docs, lexicon).collect()}
    assert found[1]["predicted"] == 1 and found[None]["predicted"] == 1
    assert all(found[k]["predicted"] == 0 for k in (2, 3, 4, 5)) and all(0 <= r["score"] <= 1 for r in found.values())
    assert toxicity.score(docs.where("doc_id > 9"), lexicon).count() == 0


def test_toxicity_without_labels(spark):
    lexicon = toxicity.fit(spark.createDataFrame([(1, "x", 0), (None, "y", 1), (3, None, 1), (4, "z", None)], "k long, t string, y int"), "k", "t", "y")
    docs = spark.createDataFrame([(1, "anything")], "doc_id long, text string")
    assert toxicity.score(docs, lexicon).first()["predicted"] == 0


def test_held_out_toxicity(spark):
    big = "/root/testdata/sf0.01"
    sf = big if pathlib.Path(big).exists() else SF
    found = queries.op1_toxicity(spark, sf).where("held_out").toPandas()
    truth = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").toPandas()
    both = found.merge(truth, on="doc_id")
    clean, toxic = both[both.toxic == 0], both[both.toxic == 1]
    assert (clean["predicted"] == 0).mean() > 0.95
    assert (toxic["predicted"] == 1).mean() > 0.7

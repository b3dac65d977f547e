"""Vector codes, importance resampling and token shards against brute force on small inputs."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from physio_spark.llm import importance, token_store, vector_codes
from physio_spark.llm.token_ids import WordIds
from physio_spark.llm.wavelet import WaveletMatrix

TOKENS = public_tokenizers.path("word_bpe_49k.json")

# ---------------------------------------------------------------- vector codes


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Rows (key, vector) that take part, in plain whole numbers."""
    width = len(rows[0][1]) // parts
    cut = [(k, [[math.floor(x * scale) for x in v[p * width : (p + 1) * width]] for p in range(parts)]) for k, v in rows]
    books = [[q[p] for _, q in sorted(cut)[:entries]] for p in range(parts)]

    def nearest(p, x):
        away = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in books[p]]
        return away.index(min(away)), min(away)

    for _ in range(rounds):
        moved = []
        for p in range(parts):
            own = [[] for _ in books[p]]
            for _, q in cut:
                own[nearest(p, q[p])[0]].append(q[p])
            moved.append([[sum(c) // len(c) for c in zip(*x, strict=True)] if x else e for x, e in zip(own, books[p], strict=True)])
        books = moved
    found = [(k, [nearest(p, q[p]) for p in range(parts)]) for k, q in cut]
    return {k: ("".join("%02x" % i for i, _ in x), sum(d for _, d in x)) for k, x in found}, books


VECTORS = "vec_id long, embedding array<float>, label int, code string, v int, slot long"


@pytest.mark.parametrize("spread", [0.5, 30_000.0])
def test_codes_are_those_of_brute_force(spark, spread):
    rng = np.random.default_rng(4)
    own = [(int(i), [float(np.float32(x)) for x in rng.normal(0, spread, 16)]) for i in rng.permutation(150)]
    own += [(150 + i, own[i][1]) for i in range(20)]
    bad = [(900, None), (901, [None] + [0.0] * 15), (902, [math.nan] * 16), (903, [math.inf] + [0.0] * 15), (904, []), (-1, [1.0] * 8)]
    rows = [(k, v, k % 3 if k % 7 else None, "x", 1, 2) for k, v in own + bad]
    vectors = spark.createDataFrame(rows, VECTORS).repartition(5)
    books = vector_codes.fit(vectors)
    want, entries = brute_codes(own)
    assert books.entries.tolist() == entries
    digest = ",".join(str(x) for p in entries for e in p for x in e)
    assert books.sha256() == hashlib.sha256(digest.encode()).hexdigest()
    coded = vector_codes.with_label_error(vector_codes.encode(vectors, books)).collect()
    assert {r["vec_id"]: (r["code"], r["error"]) for r in coded} == want
    assert len(coded) == len(own)
    of_label = {}
    for r in coded:
        of_label[r["label"]] = of_label.get(r["label"], 0) + r["error"]
    assert all(r["label_error"] == of_label[r["label"]] for r in coded)
    assert None in of_label
    away = np.array(dict(own)[5]) - books.decode([want[5][0]])[0]
    assert (away**2).sum() * 4096**2 == pytest.approx(want[5][1], rel=0.05)


def test_codes_of_few_odd_and_no_vectors(spark):
    rows = [(2, [1.0, 2.0, 3.0], 1, "", 0, 0), (1, [1.0, 2.0, 3.0], 1, "", 0, 0), (1, [0.0, 0.0, 1.0], 1, "", 0, 0), (None, [5.0, 5.0, 5.0], None, "", 0, 0)]
    vectors = spark.createDataFrame(rows, VECTORS)
    books = vector_codes.fit(vectors, parts=2, rounds=2)
    assert books.entries.shape == (2, 4, 2)  # fewer entries than asked for, a part filled up with zeros
    found = vector_codes.encode(vectors, books).collect()
    assert sorted((r["vec_id"] or 0, r["error"]) for r in found) == [(0, 0), (1, 0), (1, 0), (2, 0)]
    none = vectors.where("vec_id > 5")
    assert vector_codes.with_label_error(vector_codes.encode(none, vector_codes.fit(none))).count() == 0
    empty = vectors.select("vec_id", "label").selectExpr("*", "cast(array() as array<float>) as embedding")
    books = vector_codes.fit(empty)
    assert {(r["code"], r["error"]) for r in vector_codes.encode(empty, books).collect()} == {("00" * 8, 0)}
    with pytest.raises(ValueError):
        vector_codes.encode(vectors.withColumnRenamed("vec_id", "Error"), books, key="Error")
    with pytest.raises(OverflowError):
        vector_codes.fit(spark.createDataFrame([(1, [1e30] * 8, 1, "", 0, 0)], VECTORS))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(1, 28), st.integers(0, 2**32))
def test_limbed_products_are_exact(width, bits, seed):
    rng = random.Random(seed)
    most = 1 << bits
    a = np.array([[[rng.randint(-most, most) for _ in range(width)] for _ in range(3)]])
    b = np.array([[[rng.randint(-most, most) for _ in range(4)] for _ in range(width)]])
    assert (vector_codes.dot(vector_codes.limbs(a, most), vector_codes.limbs(b, most)) == a @ b).all()
    split = vector_codes.limbs(a, most)
    assert sum(int(x) << 12 * i for i, x in enumerate(split[:, 0, 0, 0])) == a[0, 0, 0]


# ---------------------------------------------------------------- importance resampling


def own_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_resample(docs, target, longest, buckets, least, percent):
    runs = lambda w: [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    corpus, wanted = [0] * buckets, [0] * buckets
    for counts, texts in ((corpus, [t for _, t in docs]), (wanted, target)):
        for t in texts:
            for f in runs(own_words(t)):
                counts[bucket(f)] += 1
    s_all, t_all = sum(corpus), sum(wanted)
    gain = [math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))) for s, t in zip(corpus, wanted, strict=True)]
    out = []
    for key, t in docs:
        own = runs(own_words(t))
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{key}".encode()).hexdigest()[:8], 16)
        out.append((key, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(own_words(t)) >= least))
    able = sorted((-r[3], r[0]) for r in out if r[4])
    drawn = {key: i + 1 for i, (_, key) in enumerate(able[: percent * len(able) // 100])}
    return {r[0]: (*r[1:4], drawn.get(r[0])) for r in out}


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_is_that_of_brute_force(spark, longest):
    rng = random.Random(8)
    vocabulary = ["the", "Cat", "größe", "12a", "x" * 3000, "你好", "a-b", "İ", "Don't", "\x00nul", "end."] + [f"w{i}" for i in range(60)]
    docs = [(i, rng.choice([" ", "  ", "\n", ", "]).join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, " .,"), (303, "word " * 30_000)] + [(304 + i, docs[7][1]) for i in range(30)]
    target = ["the Cat 12a end", None, "w1 w2 w3 the Cat"]
    frame = spark.createDataFrame([(k, t, 1, 2, "s") for k, t in docs], "doc_id long, text string, _at int, t int, rank string").repartition(7)
    got = importance.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, buckets=997, percent=25)
    want = brute_resample(docs, target, longest, 997, 20, 25)
    assert {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in got.collect()} == want


def test_resampling_of_nulls_ties_and_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(None, "a b c")] * 3 + [(1, "a b c")] * 4, "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    rows = importance.resample(docs, none, least_words=1, percent=50).collect()
    assert len(rows) == 7
    assert sorted(r["rank"] for r in rows if r["rank"]) == [1, 2, 3]
    assert importance.resample(docs.where("doc_id = 9"), none).count() == 0
    scored = spark.createDataFrame([(i, i % 4) for i in range(100)], "doc_id long, score long")
    monkeypatch.setattr(importance, "RANK_ROWS", 7)
    ranked = {r["doc_id"]: r["rank"] for r in importance.draw(scored, 30).collect()}
    order = sorted(range(100), key=lambda i: (-(i % 4), i))
    assert ranked == {i: n + 1 if n < 30 else None for n, i in enumerate(order)}


def test_words_beyond_the_automaton_count_alike(monkeypatch):
    texts = pa.array([" ".join(f"w{i * j % 50}" for i in range(200)) for j in range(9)])
    whole = [x.tolist() for x in importance.Words().scan(texts)]
    monkeypatch.setattr(importance, "REMEMBERED", 5)
    few = importance.Words()
    few.scan(texts)
    assert len(few.crc) == 5
    assert [x.tolist() for x in few.scan(texts)] == whole


# ---------------------------------------------------------------- token shards


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=1500), st.integers(0, 41))
def test_wavelet_matrix_answers_as_the_sequence(values, one):
    own = np.array(values, np.uint16)
    matrix = WaveletMatrix.of(own, 6)
    assert matrix.decode(np.uint16).tolist() == values
    assert matrix.access(np.arange(len(own))).tolist() == values
    places = [i for i, x in enumerate(values) if x == one]
    assert matrix.find(one).tolist() == places
    lo, hi = len(values) // 3, 2 * len(values) // 3
    assert matrix.count(one, lo, hi) == sum(lo <= i < hi for i in places)
    assert matrix.find(one, lo, hi).tolist() == [i for i in places if lo <= i < hi]
    with pytest.raises(IndexError):
        matrix.select(one, np.array([len(places)]))


ODD = [
    "Don't stop", "dogs'sale \"x's\" 12345 a1b2c3", "x<|endoftext|>y <|ENDOFTEXT|> <|startoftext|>", "ΑΣ.Α ΑΣ İstanbul ǅ ﬁ éa é…,x —,! ¿qué?",
    "你好,世界 がぎ が ١٢٣", "a b c\x0bd\x1ce\x85f", "", None, "  ", "x" * 30_000, "'s 's's !'s a'S 'Ll `~^ ____ a_b-c",
    "﻿a​b \U0001f600x \x00a\x00 \x7f", "word " * 20_000,
]


def test_ids_are_those_of_whole_texts():
    tokenizer, words = Tokenizer.from_file(TOKENS), WordIds(TOKENS)
    for _ in range(2):  # learned, then remembered
        assert [x.tolist() for x in words.encode(pa.array(ODD))] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in ODD]


@pytest.mark.parametrize("shard", [1, 300, 8 << 20])
def test_shards_hold_every_document(spark, tmp_path, monkeypatch, shard):
    monkeypatch.setattr(token_store, "SHARD_TOKENS", shard)
    monkeypatch.setattr(token_store, "PART_BYTES", 20_000)
    monkeypatch.setattr(token_store, "BLOCK_BYTES", 2_000)
    tokenizer = Tokenizer.from_file(TOKENS)
    texts = ODD + [f"text {i % 9} of many, {'again ' * (i % 30)}" for i in range(200)]
    rows = [(7 * i % 1000 - 50, t, "x", 1) for i, t in enumerate(texts)] + [(5000, "same", "x", 1)] * 3 + [(None, "no key", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, ids int").repartition(6)
    files = token_store.write(docs, TOKENS, str(tmp_path))
    found = token_store.read(files, str(tmp_path)).collect()
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in {(r[0], r[1]) for r in rows}}
    at, want = 0, []
    for key in sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0)):
        want.append((key, at, len(ids[key]), np.array(ids[key], "<u4").tobytes()))
        at += len(ids[key])
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in found), key=lambda r: r[1]) == want
    assert token_store.read(files, str(tmp_path)).rdd.getNumPartitions() == files.count()
    # counting and lookup without decoding
    wanted = [1, ids[5000][0], 48_000, 70_000]
    every = [(t, key, i) for key, own in ((r[0], ids[r[0]]) for r in rows) for i, t in enumerate(own) if t in wanted]
    counted = {r["token"]: r["n"] for r in token_store.counts(files, str(tmp_path), wanted).collect()}
    assert counted == {t: sum(x == t for x, _, _ in every) for t in wanted}
    key = lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])
    assert sorted((tuple(r) for r in token_store.occurrences(files, str(tmp_path), wanted).collect()), key=key) == sorted(every, key=key)


def test_an_empty_table_has_no_shard(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id string, text string")
    files = token_store.write(docs, TOKENS, str(tmp_path))
    assert files.count() == 0
    assert token_store.read(files, str(tmp_path), kind="string").count() == 0
    with pytest.raises(ValueError):
        token_store.read(files, str(tmp_path), key="start")


def test_a_shard_is_read_by_sections_and_checked():
    ids = np.array([5, 9, 1, 5, 5, 1, 1], np.uint16)
    data = b"".join(token_store.shard_bytes(pa.array(["a", "b", None]), np.array([3, 3, 1]), ids, 16))
    shard = token_store.TokenShard(pa.BufferReader(data))
    assert [shard.document(i).tolist() for i in range(3)] == [[5, 9, 1], [5, 5, 1], [1]]
    assert [x.tolist() for x in shard.where(5)] == [[0, 1, 1], [0, 0, 1]]
    assert shard.keys.to_pylist() == ["a", "b", None]
    assert shard.matrix.count(9) == 1
    with pytest.raises(token_store.DamagedShard):
        token_store.TokenShard(pa.BufferReader(data[:40]))
    with pytest.raises(token_store.DamagedShard):
        token_store.TokenShard(pa.BufferReader(b"x" + data[1:]))
    bits = {name: at for name, at, *_ in json.loads(data[16 : 16 + int.from_bytes(data[8:12], "little")])["sections"]}["bits3"]
    broken = bytearray(data)
    broken[16 + int.from_bytes(data[8:12], "little") + bits] ^= 1
    with pytest.raises(token_store.DamagedShard):
        token_store.TokenShard(pa.BufferReader(bytes(broken))).document(0)

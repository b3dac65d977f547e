"""Neighbour search, pages, archives, decontamination, packing and the pipeline on small inputs."""

import gzip
import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from physio_spark.llm import ann, decontaminate, html_extract, packing, warc

SF = "/root/testdata/sf0.001"
TOKENS = public_tokenizers.path("word_bpe_49k.json")


def exact(rows, queries, k):
    usable = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in queries:
        if q in usable:
            x = usable[q]
            near = sorted((-(x * y).sum() / (np.linalg.norm(x) * np.linalg.norm(y)), i) for i, y in usable.items() if i != q)
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    return out


def test_neighbours_reach_the_recall(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    got = found(ann.search(vectors, F.col("vec_id") % 5 == 0))
    want = exact(rows, [i for i, _ in rows if i % 5 == 0], 5)
    assert got.keys() == want.keys()
    hit = sum(len({x[0] for x in got[q]} & {x[0] for x in want[q]}) for q in want)
    assert hit / sum(map(len, want.values())) >= 0.9
    scores = {(q, i): s for q, l in exact(rows, want, len(rows)).items() for i, s in l}
    assert all(abs(scores[q, i] - s) < 1e-12 for q, l in got.items() for i, s, _ in l)
    assert all([x[2] for x in l] == [1, 2, 3, 4, 5] for l in got.values())


def test_neighbours_of_odd_vectors_and_copies(spark):
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 1) for _ in range(6)]) for k in range(40)]
    rows += [(100 + k, [1.0, 2.0, 3.0, 0.0, -0.0, 1e-30]) for k in range(60)]  # copies
    rows += [(200 + k, [2.0**k, 0.0, 0.0, 0.0, 0.0, 0.0]) for k in range(8)]  # one direction
    rows += [(300, None), (301, []), (302, [0.0] * 6), (303, [1.0, None, 0, 0, 0, 0]), (304, [float("nan")] + [1.0] * 5), (305, [float("inf")] + [1.0] * 5), (306, [1.0]), (None, [1.0] * 6)]
    frame = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 9.0, "b") for i, v in rows], "vec_id long, embedding array<double>, score double, bucket string")
    got = found(ann.search(frame, F.lit(True), probes=16, tables=12))
    want = exact([r for r in rows if r[0] != 306], [i for i, _ in rows], 5)
    assert got.keys() == {q for q in want if q is not None}
    same = sum([x[0] for x in got[q]] == [x[0] for x in want[q]] for q in got)
    assert same >= 0.95 * len(got)
    assert [x[0] for x in got[100]] == [101, 102, 103, 104, 105] and [x[0] for x in got[159]] == [100, 101, 102, 103, 104]
    assert [x[0] for x in got[203]] == [200, 201, 202, 204, 205]


def test_neighbours_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.search(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    assert ann.search(spark.createDataFrame([(1, [1.0, 0.0])], schema), F.lit(True)).count() == 0
    two = found(ann.search(spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0])], schema), F.lit(True)))
    assert {q: [(i, s) for i, s, _ in l] for q, l in two.items()} == {1: [(2, 1.0)], 2: [(1, 1.0)]}


PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies and you will have to like it.</div>
<div id=sidebar><p>%s</p></div><!-- note --><article><header><h2>Title &amp; more</h2></header><p>First   para <b>b</b>old
text&nbsp;of &lt;i&gt;.<p>Tiny.<div class="ad">Buy this</div><ul><li>one<li>two</ul><form><p>Sign up</p></form>
<blockquote>He said &quot;so&#33;&quot;</blockquote><script>var t="</p>";</script>
<div class="comments"><p>%s</p></div></article><footer>&copy; 2024</footer></body></html>"""
LONG = "This is what the reader of the page had to say about it, and it was not of the kind that one would want to see in the text at all. " * 2


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE % (LONG, LONG), 'Title & more\nFirst para bold text of <i>.\nTiny.\none\ntwo\nHe said "so!"'),
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("<p>" + LONG + "</p><p>Short.</p><ul><li><a href=x>Home</a><li><a href=y>About</a></ul>", " ".join(LONG.split())),
        ("<article><p>only a <b>few</b> words", "only a few words"),
        ("<article><p>a &amp b &am; &#x41; &unknown; <3 > 2</p><script>never closed <p>x", "a & b &am; A &unknown; <3 > 2"),
        ("<main><p>open <!-- never closed <p>x", "open"),
        ("<article></article><p>x</p>", ""),
        ('<article><p title="a>b" class=\'x\'>kept</p><p class="advert">gone</p><p hidden>gone</p></article>', "kept"),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumn("text", F.lit("taken"))
    got = html_extract.extract(pages).collect()
    assert len(got) == pages.count() and all(r["text"] == "taken" for r in got)
    assert all(r["main_text"] and "track(" not in r["main_text"] for r in got if r["html"])
    with pytest.raises(ValueError, match="column"):
        html_extract.extract(pages, text="TEXT")
    long = spark.createDataFrame([(1, "<article>" + "<p>word " * 200_000)], "page_id long, html string")
    assert html_extract.extract(long).first()["main_text"].count("\n") == 199_999
    assert html_extract.extract(long.where("page_id > 1")).count() == 0


PAGES = [(3, "http://b/ x", "y" * 150), (1, None, "y" * 150), (2, "u", "z" * 99), (4, "u", "z" * 99), (5, "u", None), (6, "u", ""), (7, "u", "é" * 60), (8, "u", "é" * 60), (None, "u", "y" * 150), (9, "u", "WARC/1.1\r\nx" * 30), (9, "u", "WARC/1.1\r\nx" * 30)]


def test_archive_round_trip(spark):
    pages = spark.createDataFrame([(*r, "d") for r in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    folder = warc.archive_folder(spark)
    files = warc.write(pages, folder, file_bytes=700)
    assert files.agg(F.sum("records")).first()[0] == len(PAGES)
    rows = warc.read(files, folder, payload=True).collect()
    assert all(r["error"] is None for r in rows) and len(rows) == len(PAGES)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    revisits = {3: "1", 8: "7"}
    want = sorted((str(i or ""), len((t or "").encode()), sha(t), "revisit" if i in revisits else "response", str(revisits.get(i))) for i, _, t in PAGES)
    assert sorted((r["record_id"], r["payload_length"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in rows) == want
    assert {bytes(r["payload"]).decode() for r in rows if r["record_type"] == "response"} == {t or "" for _, _, t in PAGES}
    assert warc.read(warc.write(pages.where("page_id > 99"), warc.archive_folder(spark)), folder).count() == 0


def salvage(tmp_path, data):
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    with pa.OSFile(str(path)) as file:
        reader = warc.Salvage(file)
        return [r.headers["warc-record-id"] for _, r in reader], reader.gaps


def test_salvage(tmp_path):
    rng = random.Random(4)
    plain = [warc.record(str(k), f"u{k}", bytes(rng.choices(b"ab \r\n", k=400)), 400, "x", None) for k in range(5)]
    parts = [warc.member(p) for p in plain]
    ids = [f"<urn:page:{k}>" for k in range(5)]
    assert salvage(tmp_path, b"".join(parts)) == (ids, [])
    assert salvage(tmp_path, b"".join(plain)) == (ids, [])
    assert salvage(tmp_path, parts[0] + plain[1] + parts[2]) == (ids[:3], [])
    assert salvage(tmp_path, b"") == ([], [])
    assert salvage(tmp_path, b"junk") == ([], [(0, 4, "neither a member nor a version line")])
    at = len(parts[0])
    for k in range(8, len(parts[1]) - 1, 17):  # a byte of the second member turned
        torn = parts[1][:k] + bytes([parts[1][k] ^ 0x55]) + parts[1][k + 1 :]
        got, gaps = salvage(tmp_path, parts[0] + torn + parts[2])
        assert got in ([ids[0], ids[2]], ids[:3])
        if got != ids[:3]:
            assert (gaps[0][0], gaps[-1][1]) == (at, at + len(torn))
    got, gaps = salvage(tmp_path, parts[0] + parts[1][:100] + b"#" * 300_000 + parts[2] + parts[3][:50])
    assert got == [ids[0], ids[2]]
    assert [(a, b) for a, b, _ in gaps] == [(at, at + 300_100), (at + 300_100 + len(parts[2]), at + 300_150 + len(parts[2]))]
    wrong = plain[1].replace(b"Content-Length: 4", b"Content-Length: 9", 1)
    assert salvage(tmp_path, plain[0] + wrong + plain[2])[0] == [ids[0], ids[2]]
    both = warc.member(plain[0] + wrong + plain[2])
    assert salvage(tmp_path, both + parts[3]) == ([ids[0], ids[2], ids[3]], [(0, len(both), "wrong length")])
    assert gzip.decompress(b"".join(parts)) == b"".join(plain)


def test_leaks(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("bcdfglmnprst", k=2)) + rng.choice("aeiou") + rng.choice("nrst")
    text = lambda n: " ".join(rng.choice([word(), "the", "of", "and"]) for _ in range(n))
    items = [f"{text(20)}. {text(12)}." for _ in range(30)]
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, "too short")], "item_id long, text string")
    some = lambda t: " ".join(w if k % 6 else "other" for k, w in enumerate(t.split()))
    rows = [(k, text(rng.randrange(5, 300))) for k in range(150)]
    rows += [(200, f"{text(80)} {items[3]} {text(70)}"), (201, items[4].upper()), (202, f"{text(9)} {some(items[5])} {text(200)}"), (203, f"{text(2000)} {items[6]} {items[7]}")]
    rows += [(204, None), (205, ""), (206, " ".join(reversed(items[8].split()))), (None, items[9]), (207, " ".join(items[10].split()[:12])), (200, f"{text(80)} {items[3]}")]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, item_id double").repartition(3)
    indexes = decontaminate.fit(docs, bench)
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, indexes).collect()), key=str)
    assert got == sorted([(200, 3), (200, 3), (201, 4), (202, 5), (203, 6), (203, 7), (None, 9)], key=str)
    kept = decontaminate.keep_clean(docs, indexes)
    assert kept.schema == docs.schema and kept.count() == len(rows) - 6
    assert decontaminate.leaks(docs, decontaminate.fit(docs, bench.where("item_id > 89"))).count() == 0
    none = docs.where("doc_id > 999")
    assert decontaminate.leaks(none, decontaminate.fit(none, bench)).count() == 0


def test_common_length():
    rng = random.Random(6)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [0] * 0 + [v for v in _step(row, x, b)]
        assert decontaminate.common_length(np.array(a), np.array(b)) == row[-1]


def _step(row, x, b):
    best = 0
    for k, y in enumerate(b):
        best = max(best, row[k + 1], row[k] + 1 if x == y else 0)
        yield best


ODD = ["It's <|endoftext|> I'LL don't 'S x'd... ÉA%% Σίσυφος ΣΑΣ. é% İx  ...'re ½x% x² 12%% №5", "", " \n", None, "«Él» ¿qué? ¡no! ﬁn% 漢字! x́%", "word " * 5000, "a\x0bb\x1cc\x85d e"]


def test_token_ids_are_the_tokenizers():
    plain = Tokenizer.from_file(TOKENS)
    got = [x.tolist() for x in packing.WordIds(TOKENS).encode(pa.array(ODD))]
    assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in ODD]


def check_packed(rows, capacity):
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


def test_pack_round_trip(spark):
    docs = spark.createDataFrame([(k, t, 5) for k, t in enumerate(ODD * 3)] + [(None, "x", 5)], "doc_id long, text string, length int").repartition(3)
    rows = packing.pack(docs, TOKENS, capacity=64, ids=True).collect()
    check_packed(rows, 64)
    plain = Tokenizer.from_file(TOKENS)
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["ids"], r["ids_crc32"]))
    assert set(pieces) == {*range(len(ODD) * 3), None}
    for k, own in pieces.items():
        own.sort()
        whole = [x for _, _, ids, _ in own for x in ids]
        assert whole == plain.encode("x" if k is None else ODD[k % len(ODD)] or "", add_special_tokens=False).ids + [0]
        assert [s for _, s, _, _ in own] == [64 * n for n in range(len(own))]
        assert all(c == zlib.crc32(np.array(ids, "<u4").tobytes()) for _, _, ids, c in own)


@pytest.mark.parametrize("stretch", [30, 1000, 50_000])
def test_best_fit_is_tight(spark, monkeypatch, stretch):
    monkeypatch.setattr(packing, "SWEEP_ROWS", stretch)
    rng = random.Random(stretch)
    sizes = [min(100, max(1, int(rng.lognormvariate(3, 1)))) for _ in range(1500)] + [70] * 300 + [100] * 20
    items = spark.createDataFrame(list(enumerate(sizes)), "id long, length long")
    rows = items.join(packing.best_fit(items, 100), "id").collect()
    assert len(rows) == len(sizes)
    n = check_packed(rows, 100)
    gaps = []
    for s in sorted(sizes, reverse=True):  # best fit decreasing, one after the other
        fits = [k for k, g in enumerate(gaps) if g >= s]
        if fits:
            gaps[min(fits, key=gaps.__getitem__)] -= s
        else:
            gaps.append(100 - s)
    assert n <= len(gaps) * 1.03 + 1
    assert packing.best_fit(items.where("id < 0"), 100).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash", "decontaminate", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert 0 < out.count() <= docs.count()
        assert stage(spark, docs.where("doc_id < 0"), SF).count() == 0, name
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "Plain words of a text.", None, "s", 22)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() >= 1


def test_pipeline_is_its_stages(spark):
    """The whole run against the stages' own rules, each by hand on what the one before left."""
    rows = corpus_pipeline.run(spark, SF).collect()
    check_packed(rows, 2048)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs = {i: t for i, t in docs.items() if t and any(c.isalpha() for c in t)}
    from .test_dedup import lines_by_hand, near_by_hand

    docs = {i: t for i, t, *_ in lines_by_hand(sorted(docs.items()))}
    docs = {i: docs[i] for i, _, c in near_by_hand(sorted(docs.items())) if i == c}
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {i: t for i, t in docs.items() if not any(x in " ".join(t.lower().split()) for x in items)}
    plain = Tokenizer.from_file(TOKENS)
    want = {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in docs.items()}
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def brute_leaks(rows, index, verbatim=0.8, paraphrase=0.6):
    """All spans of all texts against all items."""
    codes_of = decontaminate.Codes(index.vocabulary)
    out = set()
    for i, t in rows:
        codes, _ = codes_of.lay(pa.array([t]))
        for item in index.items:
            n = len(item.codes)
            weight = lambda c: float(index.idf[list(c)].astype(float).sum())
            for a in range(max(1, len(codes) - 2 * n - 3)):
                span = codes[a : a + 2 * n + 4]
                if weight(item.distinct & set(span.tolist())) < paraphrase * weight(item.distinct):
                    continue
                same = decontaminate.common_length(item.codes, span) / n
                if same >= verbatim or same >= paraphrase and decontaminate.common_length(item.answer, span) >= 0.8 * len(item.answer):
                    out.add((i, item.ident))
                    break
    return out


def test_leaks_of_mixed_lengths_among_rare_words(spark):
    """Plainly worded items of 9 to 60 words between names, codes and numbers that weigh far more."""
    rng = random.Random(31)
    common = [f"plain{k}" for k in range(150)]
    items = [" ".join(rng.choices(common, k=rng.choice([9, 14, 26, 37, 45, 60]))) + "." for _ in range(24)]
    rows = [(k, " ".join(rng.choices(common, k=120))) for k in range(40)]
    for k, item in enumerate(items):
        rare = lambda n: " ".join(f"K{rng.randrange(10**9)}" for _ in range(n))
        rows.append((100 + k, f"{rare(80)} {item} {rare(80)}"))
        words = item.split()
        gone = set(rng.sample(range(len(words)), len(words) // 7))
        rows.append((200 + k, f"{rare(50)} {' '.join(rare(1) if j in gone else w for j, w in enumerate(words))} {rare(50)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    (index,) = decontaminate.fit(docs, spark.createDataFrame([*enumerate(items)], "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, [index]).collect()}
    assert {(100 + k, k) for k in range(24)} <= got
    assert got == brute_leaks(rows, index)


def test_short_items_and_scripts_without_blanks(spark):
    items = [(1, "Who wrote Faust?"), (2, "東京の首都はどこですか。答えは東京です。"), (3, "什么"), (4, "one two three four five six seven eight nine ten"), (5, "..."), (6, "aa bb aa cc")]
    rows = [
        (1, "They asked: who wrote FAUST, and when?"), (2, "Who wrote the play Faust?"), (3, "前文。東京の首都はどこですか。答えは東京です。後文"),
        (4, "他说什么"), (5, "one two three four five six seven eight nine ten"), (6, "faust"), (7, "wrote Faust? Who"), (8, "x aa bb aa bb aa cc y"), (9, "Who wrote"), (10, "Faust"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    indexes = decontaminate.fit(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, indexes).collect()}
    assert got == {(1, 1), (3, 2), (4, 3), (5, 4), (8, 6)}
    assert {r["doc_id"] for r in decontaminate.keep_clean(docs, indexes).collect()} == {2, 6, 7, 9, 10}


def test_words_are_coded_together_as_one_by_one():
    """A dictionary lookup for each of half a million distinct words was most of the layout's time."""
    odd = ["", " \t ", "Ab-c. 'x' don't \x1c\x1dq a\x1cb ÄÖ ß", "日本語 word한국어 ก็", "--- ... a_b _a_ 1,000 ½ x²", "İstanbul K ſ \x00a\x7f a\x80 ~\x7f~", None]
    many = [" ".join(f"W{k * 7 + j}," for j in range(7)) for k in range(20_000)]
    vocabulary = {w: k for k, w in enumerate(["a", "don't", "x", "k", "日", "w5"])}
    size = len(vocabulary)
    asked = []

    class Counted(decontaminate.Codes):
        def __missing__(self, raw):
            asked.append(raw)
            return super().__missing__(raw)

    codes, ends = Counted(vocabulary).lay(pa.array(odd + many, pa.string()))
    wanted = [[w for w in decontaminate.words_of(t or "")] for t in odd + many]
    assert ends.tolist() == np.cumsum([len(w) for w in wanted]).tolist()
    assert codes.tolist() == [vocabulary.get(w, size + zlib.crc32(w.encode()) % decontaminate.FOREIGN) for t in wanted for w in t]
    assert len(asked) < 20


def test_stretches_of_any_length_are_summed():
    rng = np.random.default_rng(3)
    rows, sizes = rng.standard_normal((50, 8)), np.array([1, 1, 2, 3, 1, 4, 5, 40, 64, 65, 1, 700])
    at, values = rng.integers(0, 50, sizes.sum()), rng.standard_normal(sizes.sum())
    first = np.cumsum(sizes) - sizes
    assert np.allclose(decontaminate._summed(rows, at, values, first), np.add.reduceat(rows[at] * values[:, None], first))
    assert decontaminate._summed(rows, at[:0], values[:0], first[:0]).shape == (0, 8)


def test_latent_basis_is_that_of_all_passages(spark):
    """Against the singular vectors of the whole matrix; the layout in many parts gives the same."""
    rng = random.Random(12)
    topics = [[f"t{k}w{j}" for j in range(30)] for k in range(6)]
    rows = [(k, " ".join(rng.choices(topics[k % 6], k=rng.choice([0, 3, 40, 200])))) for k in range(300)] + [(900, None)]
    docs = spark.createDataFrame(rows, "key long, t string").repartition(7)
    vocabulary = {w: k for k, w in enumerate(sorted({w for t in topics for w in t[:20]}))}
    size = len(vocabulary) + decontaminate.FOREIGN
    laid = decontaminate.lay_out(docs, vocabulary)
    codes_of = decontaminate.Codes(vocabulary)
    told = {r["key"]: np.frombuffer(r["codes"], "<u2").tolist() for r in laid.collect()}
    assert told == {k: codes_of.lay(pa.array([t], pa.string()))[0].tolist() for k, t in rows}
    counts, n = decontaminate.document_frequencies(laid, size)
    assert n == 301 and counts.tolist() == np.bincount([c for codes in told.values() for c in set(codes)], minlength=size).tolist()
    idf = np.log((n + 1) / (counts + 1.0)).astype(np.float32) + 0.01
    whole = []
    for codes in told.values():
        for lo in range(0, len(codes), decontaminate.PASSAGE):
            times = np.bincount(codes[lo : lo + decontaminate.PASSAGE], minlength=size)
            row = np.where(times > 0, 1 + np.log(np.maximum(times, 1)), 0) * idf
            whole.append(row / np.linalg.norm(row))
    whole = np.array(whole)
    given = np.random.default_rng(1).standard_normal((size, 5))
    assert np.allclose(decontaminate.gram_product(laid, idf, given), whole.T @ (whole @ given), atol=1e-3)
    basis = decontaminate.latent_basis(laid, idf)
    exact = np.linalg.svd(whole, full_matrices=False)[2][:6].T  # one direction for each topic
    assert np.allclose(basis.T @ basis, np.eye(decontaminate.RANK), atol=1e-6)
    assert np.linalg.norm(basis[:, :6].T @ exact, axis=0).min() > 0.99


def test_paraphrases_are_found_by_the_latent_search(spark):
    """Clauses that changed places keep half of an item in order: no span of the first rule, but a candidate with its answer."""
    rng = random.Random(21)
    words = [[f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in (f"ne{k}", f"ra{k}", f"so{k}", f"ti{k}")] for k in range(8)]
    text = lambda k, n: " ".join(rng.choices([*words[k], "the", "of"], k=n))
    clauses = [[text(k % 8, 9) for _ in range(4)] + [text(k % 8, 6)] for k in range(40)]
    items = [f"{', '.join(c[:4])}. {c[4]}." for c in clauses]
    rows = [(k, text(k % 8, 150)) for k in range(200)]
    for k, c in enumerate(clauses):
        rows.append((1000 + k, f"{text((k + 3) % 8, 40)} {c[2]} {c[3]} {c[0]} {c[1]}. {c[4]}. {text((k + 3) % 8, 40)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    indexes = decontaminate.fit(docs, spark.createDataFrame([*enumerate(items)], "item_id long, text string"))
    pairs = lambda **terms: {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, indexes, **terms).collect()}
    want = {(1000 + k, k) for k in range(40)}
    got, without = pairs(), pairs(cosine=2.0)
    assert len(got & want) >= 36 and len(without & want) <= 12
    assert without <= got and not {d for d, _ in got if d < 1000}
    assert pairs(fitted=True) == got
    assert decontaminate.keep_clean(docs, indexes).count() == len(rows) - len({d for d, _ in got})


BODY = " ".join(LONG.split())
CARD = '<article><h3>Other story</h3><p>Teaser of it in a few words, and it is for you to read as well as to share.</p></article>'


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div><p>{LONG}</p><p>{LONG}</p></div><div>{CARD}{CARD}</div>", f"{BODY}\n{BODY}"),  # the body is no article, the teasers are
        (f'<article style="overflow:hidden" aria-hidden="false"><p>{LONG}</p></article>', BODY),
        (f'<div data-id="comments" title="hidden role=banner"><p>{LONG}</p></div>', BODY),
        (f"<div hidden><p>{LONG}</p></div><div><p>{LONG}</p></div>", BODY),
        (f"<article><p>{LONG}</p></article><div><p>{'Zinc copper nickel cobalt ' * 8}</p><p>{LONG}</p></div>", f"{BODY}\n{BODY}"),  # no stop words
        (f"<article><p>{'Zinc copper nickel cobalt ' * 8}</p></article>", ("Zinc copper nickel cobalt " * 8).strip()),  # no known language
        (f'<article><p>{LONG}<span class="share">Share<p>{LONG}</article>', f"{BODY}\n{BODY}"),
        (f"<ul><li class=ad>Buy<li>{LONG}</ul>", BODY),
        (f"<div><p><a href=x>open<p>{LONG}</div>", BODY),
    ],
)
def test_all_blocks_are_judged(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize(
    "piece", [" a= b", "<a ", '<a x="', "<a b='c", "<a b==", "<", "</", "<!--", "<script ", "<div>", "<p>x", "<li>x", "&", "<a b " + " " * 999]
)
def test_a_page_cut_off_anywhere_is_read_in_linear_time(piece):
    page = "<article><p>The words before it are kept as they were.</p>" + "<p" * (piece == " a= b") + piece * ((1 << 20) // len(piece))
    begin = time.process_time()
    text = html_extract.main_text(page)
    assert time.process_time() - begin < 10
    assert text.startswith("The words before it are kept as they were.")


def test_archives_are_read_in_a_task_for_each_file(spark, tmp_path):
    pages = spark.createDataFrame([(i, None, f"page {i} " * 300) for i in range(40)], "page_id long, url string, html string").repartition(5)
    files = warc.write(pages, str(tmp_path), file_bytes=300)
    found = warc.read(files, str(tmp_path))
    assert found.rdd.getNumPartitions() == files.count() > 5
    tasks = found.where("error IS NULL").selectExpr("spark_partition_id() AS p").distinct().count()
    assert tasks > 5

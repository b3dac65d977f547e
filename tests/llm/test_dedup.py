"""Line, window and near-duplicate removal against brute force on small frames."""

import hashlib
import random

import pytest
import xxhash

import corpus_pipeline
from physio_spark.llm import line_dedup, near_copies, simhash, substring_dedup
from physio_spark.llm.components import components

SCHEMA = "doc_id long, text string, drop string, owner string, mark string"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA).repartition(3)


def got(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


LINES = [
    (1, "Shared line number one\nown line of one\nshort\n"),
    (2, "own line of two\n  SHARED line number one\t\nshort"),
    (3, None),
    (4, ""),
    (5, "Shared line number one\nShared line number one"),
    (6, "ÀÉ shared line\nàÉ shared line"),
    (7, "Àé shared line"),
    (8, "only in eight, twice over\nonly in eight, twice over"),
    (None, "Shared line number one\nno key"),
    (9, "x" * 300_000 + "\nShared line number one"),
]


def lines_by_hand(rows):
    space = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(space))
    first, last = {}, {}
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                first[key(x)] = min(first.get(key(x), i), i)
                last[key(x)] = max(last.get(key(x), i), i)
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        keep = [x for x in own if i is None or len(key(x)) < 10 or first[key(x)] == last[key(x)] or first[key(x)] == i]
        out.append((i, "\n".join(keep), len(own), len(own) - len(keep)))
    return sorted(out, key=str)


@pytest.mark.parametrize("segments", [1, 1024])
def test_lines_match_brute_force(spark, segments):
    kept = line_dedup.dedup_lines(frame(spark, LINES), segments=segments)
    assert kept.columns == ["doc_id", "text", "drop", "owner", "mark", "n_lines", "n_dropped"]
    assert got(kept, "doc_id", "text", "n_lines", "n_dropped") == lines_by_hand(LINES)


def test_lines_of_many_rows_and_a_full_filter(spark):
    rng = random.Random(1)
    rows = [(k, "\n".join(f"sentence number {rng.randrange(4000)}" for _ in range(rng.randrange(1, 9)))) for k in range(2000)]
    kept = line_dedup.dedup_lines(frame(spark, rows), segments=1)
    assert got(kept, "doc_id", "text", "n_lines", "n_dropped") == lines_by_hand(rows)


def test_empty_tables_stay_empty(spark):
    none = frame(spark, [(1, "x")]).where("doc_id > 1")
    assert line_dedup.dedup_lines(none).count() == 0
    assert substring_dedup.dedup_windows(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(none).count() == 0


def windows_by_hand(rows, window):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            if i is not None:
                first[x] = min(first.get(x, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, b" ".join(x for k, x in enumerate(w) if k not in gone).decode(), len(w), len(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [3, 5, 50])
def test_windows_match_brute_force(spark, window, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", 50)
    rng = random.Random(window)
    passage = [rng.choice("abcdefgh") for _ in range(2 * window)]
    rows = []
    for k in range(60):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(3 * window))]
        at = rng.randrange(len(words) + 1)
        rows.append((k, " ".join(words[:at] + passage[rng.randrange(window) :] + words[at:])))
    rows += [(100, rows[0][1]), (101, None), (102, " \n "), (None, rows[0][1]), (103, "a " * 4 * window), (103, rows[1][1]), (104, "\x1c a\xa0b " * window)]
    kept = substring_dedup.dedup_windows(frame(spark, rows), window=window)
    assert got(kept, "doc_id", "text", "n_words", "n_removed") == windows_by_hand(rows, window)


def test_tasks_of_a_shuffle_are_small(spark):
    from physio_spark.llm import common

    common.session(spark)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == common.TASK_BYTES == "16m"


def test_blocks_hold_what_is_left_of_one_bucket_only(monkeypatch):
    sizes = []

    class Noted(substring_dedup.Block):
        def __init__(self, runs, *args):
            sizes.append(sum(len(r[3]) for r in runs))
            super().__init__(runs, *args)

    monkeypatch.setattr(substring_dedup, "Block", Noted)
    passage = [" ".join(f"b{k}w{j}" for j in range(6)).encode() for k in range(300)]
    rows = [(k, d, 0, 10 * k, passage[k] if d % 2 else f"{d} of {d} {k} {d}".encode()) for k in range(300) for d in range(8)]
    rows += [(300, d, 0, 0, passage[d % 3] if d % 3 else f"{d} only {d} here {d}".encode()) for d in range(400)]  # larger than a block
    buckets, found = substring_dedup.Buckets(5, 900), []
    for lo in range(0, len(rows), 100):
        found += [r for ranges in buckets.take(iter(rows[lo : lo + 100])) for r in ranges]
        assert max(sizes, default=0) < 1000 or rows[lo][0] == 300
    found += buckets.rest()
    wanted = [(d, 0, 10 * k, 10 * k + 6) for k in range(300) for d in (3, 5, 7)] + [(d, 0, 0, 6) for d in range(4, 400) if d % 3]
    assert sorted(found) == sorted(wanted)
    assert max(sizes) < 1000 + 2 * sum(len(r[4]) for r in rows if r[0] == 300 and not r[1] % 3)


def test_window_hash_collisions_are_settled_by_words(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup.xxhash, "xxh3_64_intdigest", lambda w: 7)
    runs = [(1, 0, 0, b"a b c d e"), (2, 0, 0, b"x b c d f"), (3, 0, 0, b"q a b c z")]
    block = substring_dedup.Block(runs, 3)
    assert list(block.removed()) == [(2, 0, 1, 4), (3, 0, 1, 4)]


def fingerprint_by_hand(text, shingle=4):
    w = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[k : k + shingle]), 42) for k in range(max(1, len(w) - shingle + 1))] if w else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def near_by_hand(rows, reach=4):
    prints = [fingerprint_by_hand(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= reach:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return sorted([(i, signed(prints[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)], key=str)


def test_fingerprints_and_components_match_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for k in range(40):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 120))]
        rows.append((10 * k + 9, " ".join(words)))
        for c in range(3):
            words[rng.randrange(len(words))] = "changed"
            rows.append((10 * k + c, " ".join(words).upper()))
    rows += [(900, None), (901, ""), (902, " \t"), (None, rows[0][1]), (903, "one two"), (903, "one two"), (904, "long " * 50_000)]
    found = simhash.near_duplicates(frame(spark, rows))
    assert got(found, "doc_id", "fp", "component_id") == near_by_hand(rows)


def test_random_fingerprints_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 50)
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for p in list(prints):
        for _ in range(3):
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                p ^= 1 << b
            prints.add(p)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame_ = spark.createDataFrame([(p,) for p in signed], "fp long")
    named = {r["node"]: r["component"] for r in components(simhash.links(frame_, 4)).collect()}
    root = {p: p for p in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(signed[a]), find(signed[b])
                root[max(x, y)] = min(x, y)
    groups = {}
    for p in signed:
        groups.setdefault(find(p), set()).add(p)
    want = {p: min(g) for g in groups.values() if len(g) > 1 for p in g}
    assert named == want


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 400), (7, 7)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert found == {k: 0 for k in range(201)} | {400: 400, 500: 400}


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(3, text), (1, text), (2, text + " more"), (4, "quite another text of a few words here"), (5, None), (6, "")]
    assert got(simhash.keep_one(frame(spark, rows)), "doc_id") in ([(1,), (4,), (5,)], [(1,), (2,), (4,), (5,)])


def test_digest_of_an_emptied_document(spark):
    kept = line_dedup.dedup_lines(frame(spark, [(1, "the same line here"), (2, "the same line here")]))
    text = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert text == {1: "the same line here", 2: ""}
    assert hashlib.sha256(text[2].encode()).hexdigest().startswith("e3b0c442")


def jaccard(a, b, n=5):
    x, y = ({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("block", [500_000, 300])
def test_pipeline_drops_near_copies_of_0_8_and_more(spark, monkeypatch, block):
    """All pairs by hand; most copies of 0.8 to 0.95 differ in more than 4 bits of a SimHash."""
    monkeypatch.setattr(near_copies, "BLOCK_SHINGLES", block)
    rng = random.Random(21)
    rows = []
    for k in range(120):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([50, 90, 200]))]
        rows.append((10 * k, " ".join(words)))
        for j in range(rng.randrange(4)):  # changes at random places: similarities below and above 0.8
            copy = list(words)
            for at in rng.sample(range(len(words)), rng.randrange(1, max(2, len(words) // 25))):
                copy[at] = f"x{rng.randrange(5000)}"
            rows.append((10 * k + 1 + j, " ".join(copy)))
    rows += [(9000, None), (9001, ""), (9002, "few words"), (9003, "FEW  words"), (None, rows[0][1])]
    head = {i: i for i, _ in rows[:-5]}

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    pairs = [(a, b, jaccard(t, u)) for k, (a, t) in enumerate(rows[:-5]) for b, u in rows[:k]]
    far = 0
    for a, b, s in pairs:
        if s >= 0.8:
            head[max(root(a), root(b))] = min(root(a), root(b))
            texts_ = dict(rows[:-5])
            far += (simhash.fingerprint(texts_[a].encode()) ^ simhash.fingerprint(texts_[b].encode())).bit_count() > 4
    assert far > 20 and any(0.6 < s < 0.8 for *_, s in pairs)
    want = {i for i in head if root(i) == i and root(i) != root(0)} | {None, 9000, 9002}
    docs = frame(spark, rows)
    assert {r[0] for r in corpus_pipeline.drop_copies(spark, docs, "").select(docs.columns[0]).collect()} == want


def test_pipeline_near_copies_come_from_linked_fingerprints(spark, monkeypatch):
    words = [f"w{i}" for i in range(300)]
    changed = [*words[:150], "other", *words[151:]]
    sets = [near_copies.shingles(" ".join(w).encode()) for w in (words, changed)]
    a, b = (near_copies.set_fingerprint(s) & (1 << 64) - 1 for s in sets)
    assert a == simhash.fingerprint(" ".join(words).encode(), 5)
    assert a != b
    monkeypatch.setattr(near_copies, "REACH", (a ^ b).bit_count())
    seen, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda d, reach: seen.append(reach) or links(d, reach))
    docs = frame(spark, [(1, " ".join(words)), (2, " ".join(changed)), (3, "a text of its own with some more words")])
    assert sorted(r[0] for r in corpus_pipeline.drop_copies(spark, docs, "").select(docs.columns[0]).collect()) == [1, 3]
    assert seen == [(a ^ b).bit_count()]

"""Corpus operators on tables whose other columns have the names that the operators use."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from physio_spark.llm import (
    ann, decontaminate, html_extract, importance, language_id, line_dedup, near_copies, packing, simhash, substring_dedup, token_store, toxicity,
    vector_codes, warc,
)

TOKENS = public_tokenizers.path("word_bpe_49k.json")
NAMES = (
    "_k _m a b band bands bits bucket capacity code component component_id count cut d doc doc_id_ drop dropped end error fill first fp gap h head id ids item_id k key "
    "kept lang_pred last left length line m main_text mark n n_dropped n_features n_lines n_removed n_words node num offset own owner part path piece q r ranges rank "
    "right row score seq sequence_id size slot start stretch t token v w weight words x y"
).split()
TEXT = "These words are the first line of all\nand this one stands in two of them\n" + " ".join(f"w{i}" for i in range(70))


@pytest.fixture(scope="module")
def crowded(spark):
    rows = [(i, TEXT if i < 3 else f"another text number {i} with words of its own, not long", *["x"] * len(NAMES)) for i in range(8)]
    kinds = ", ".join(f"{n} string" for n in NAMES)
    return spark.createDataFrame([(k, None if k == 7 else t, *rest) for k, t, *rest in rows], f"doc_id long, text string, {kinds}")


PLAIN = {
    "line_dedup": lambda d: line_dedup.dedup_lines(d),
    "line_dedup_uncounted": lambda d: line_dedup.dedup_lines(d, counts=None),
    "substring_dedup": lambda d: substring_dedup.dedup_windows(d),
    "near_copies": lambda d: near_copies.keep_one(d),
    "near_pairs": lambda d: near_copies.near_copies(d).select("k", "least"),
    "simhash": lambda d: simhash.keep_one(d),
    "components": lambda d: simhash.near_duplicates(d),
    "languages": lambda d: language_id.identify(d, language_id.fit(d.withColumn("lang", F.lit("en")), "doc_id", "text", "lang")),
    "toxicity": lambda d: toxicity.score(d, toxicity.Lexicon()),
    "packing": lambda d: packing.pack(d, TOKENS, capacity=64).select("doc_id", "piece", "start", "length"),
    "leaks": lambda d: decontaminate.leaks(d, decontaminate.fit(d, d.where("doc_id = 4").select(F.col("doc_id").alias("item_id"), "text"))),
    "clean": lambda d: decontaminate.keep_clean(d, decontaminate.fit(d, d.where("doc_id = 4").select(F.col("doc_id").alias("item_id"), "text"))),
    "importance": lambda d: importance.resample(d, d.where("doc_id < 2"), least_words=3),
    "pages": lambda d: html_extract.extract(d, "text", "article"),
}


def outcome(frame):
    kept = [c for c in frame.columns if c not in NAMES or c in ("n_lines", "n_dropped", "n_words", "n_removed", "score", "rank", "weight", "n_features")]
    return sorted((str(tuple(r)) for r in frame.select(*dict.fromkeys(kept)).collect()))


@pytest.mark.parametrize("name", PLAIN)
def test_names_of_other_columns_do_not_matter(crowded, name):
    whole, bare = PLAIN[name](crowded), PLAIN[name](crowded.select("doc_id", "text"))
    assert len({c.lower() for c in whole.columns}) == len(whole.columns)
    own = [c for c in bare.columns]
    assert outcome(whole.select(*own)) == outcome(bare)
    assert whole.count() > 0


def test_stores_read_only_what_they_are_asked_for(spark, crowded, tmp_path):
    files = token_store.write(crowded, TOKENS, str(tmp_path / "t"))
    assert token_store.read(files, str(tmp_path / "t")).count() == 8
    archives = warc.write(crowded, str(tmp_path / "w"), "doc_id", "path", "text")
    assert warc.read(archives, str(tmp_path / "w")).count() == 8
    vectors = crowded.withColumn("embedding", F.array(*[(F.col("doc_id") + i).cast("float") for i in range(8)])).withColumnRenamed("x", "label")
    books = vector_codes.fit(vectors, "doc_id", entries=2)
    assert vector_codes.with_label_error(vector_codes.encode(vectors, books, "doc_id")).columns == ["doc_id", "label", "code", "error", "label_error"]
    assert ann.search(vectors, F.col("doc_id") == 1, "doc_id").count() == 5


@pytest.mark.parametrize(
    "run",
    [
        lambda d: line_dedup.dedup_lines(d, "n_lines"),
        lambda d: substring_dedup.dedup_windows(d, "n_words"),
        lambda d: packing.pack(d, TOKENS, "length"),
        lambda d: packing.pack(d, TOKENS, "offset"),
        lambda d: language_id.identify(d, None, "score"),
        lambda d: toxicity.score(d, toxicity.Lexicon(), "score"),
        lambda d: simhash.near_duplicates(d, "fp"),
        lambda d: decontaminate.leaks(d, [], "item_id"),
        lambda d: importance.resample(d, d, "rank"),
        lambda d: ann.search(d, F.lit(True), "rank"),
    ],
)
def test_keys_named_like_results_are_refused(crowded, run):
    with pytest.raises(ValueError, match="of its own"):
        run(crowded)


def test_a_key_named_id_is_kept(crowded):
    found = packing.pack(crowded.select(F.col("doc_id").alias("id"), "text"), TOKENS, "id")
    assert sorted(r["id"] for r in found.select("id").distinct().collect()) == list(range(8))

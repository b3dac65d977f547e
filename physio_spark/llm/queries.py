"""The corpus operators as queries over the supplied tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, html_extract, importance, language_id, line_dedup, packing, simhash, substring_dedup, token_store, toxicity, vector_codes, warc
from .common import remainder, session, table, unit

SQL: dict[str, str] = {}

TOXIC_SAMPLE = 20_000


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from a bounded sample of the labelled rows outside the held-out fold."""
    docs, labels = table(session(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = remainder(F.col("doc_id"), 3)
    taught = labels.where(fold != 1).select("doc_id", "toxic").dropna()
    share = F.lit(min(1.0, TOXIC_SAMPLE / max(taught.count(), 1)))
    taught = taught.where(unit(F.col("doc_id")) < share)
    own = docs.where(fold != 1).where(unit(F.col("doc_id")) < share).select("doc_id", "text")
    sample = own.join(taught, "doc_id").select(F.col("doc_id").alias("k"), F.col("text").alias("t"), F.col("toxic").cast("int").alias("y"))
    lexicon = toxicity.fit_sample(sample.dropna().where("y in (0, 1)"))
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", "predicted", "n_hits")


def language_trees(docs: DataFrame) -> language_id.ContextTrees:
    """Trees from the labelled rows outside the held-out fold."""
    return language_id.fit(docs.where(remainder(F.col("doc_id"), 4) != 2), "doc_id", "text", "lang")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document under trees learned outside the held-out fold."""
    docs = table(session(spark), sf_dir, "documents")
    found = language_id.identify(docs, language_trees(docs))
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector."""
    return ann.search(table(session(spark), sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(session(spark), sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages, text="extracted").select("page_id", "url", F.col("extracted").alias("text"), F.length("extracted").cast("long").alias("n_chars"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that a smaller document starts."""
    docs = table(session(spark), sf_dir, "documents").select("doc_id", "text")
    kept = substring_dedup.dedup_windows(docs)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL["op4_substring_dedup"] = """
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM split WHERE len(w) >= 50)
), first AS (
  SELECT h, min(doc_id) AS d FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (h) WHERE doc_id > d
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM split
), kept AS (
  SELECT doc_id, count(*) AS n, count(gone.p) AS r,
         coalesce(string_agg(word, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL), '') AS t
  FROM words LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of web archives, written and read back."""
    pages = table(session(spark), sf_dir, "pages").select("page_id", "url", "html")
    folder = warc.archive_folder(spark)
    found = warc.read(warc.write(pages, folder), folder).where("error IS NULL")
    kind = pages.schema["page_id"].dataType
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind)
    return found.select(
        number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )


SQL["op6_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha256(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, with the item; a document not in the result is clean."""
    docs = table(session(spark), sf_dir, "documents").select("doc_id", "text")
    return decontaminate.leaks(docs, decontaminate.fit(docs, table(spark, sf_dir, "benchmark")), fitted=True)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    docs = table(session(spark), sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that a smaller document holds."""
    docs = table(session(spark), sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL["op9_line_dedup"] = """
WITH lines AS (
  SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), first AS (
  SELECT k, min(doc_id) AS d FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) < max(doc_id)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE doc_id > d) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE d IS NULL OR doc_id = d), '')) AS kept_sha256
FROM keyed LEFT JOIN first USING (k) GROUP BY doc_id
"""


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    docs = table(session(spark), sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector under codebooks learned from all of them."""
    vectors = table(session(spark), sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = vector_codes.fit(vectors)
    coded = vector_codes.with_label_error(vector_codes.encode(vectors, books))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _sql_vector_codes(rounds: int = 6) -> str:
    """Rounds written out: ``aN`` assigns the parts under the codebook ``cN``, which gives ``cN+1``."""
    away = "list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    assign = """a{n} AS MATERIALIZED (SELECT vec_id, p, x, arg_min(entry, ({away}, entry)) AS entry, min({away}) AS d
  FROM parts JOIN c{n} USING (p) GROUP BY vec_id, p, x)"""
    move = """s{n} AS (SELECT p, entry, i, sum(x[i]) AS s, count(*) AS n FROM a{n}, range(1, 9) AS t(i) GROUP BY ALL),
m{n} AS (SELECT p, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS e FROM s{n} GROUP BY p, entry),
c{after} AS MATERIALIZED (SELECT p, entry, coalesce(m{n}.e, c{n}.e) AS e FROM c{n} LEFT JOIN m{n} USING (p, entry))"""
    steps = [assign.format(n=0, away=away)]
    for n in range(rounds):
        steps += [move.format(n=n, after=n + 1), assign.format(n=n + 1, away=away)]
    return (
        """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor(4096 * CAST(v AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = len(embedding)
), parts AS MATERIALIZED (
  SELECT vec_id, p, q[p * 8 + 1 : p * 8 + 8] AS x FROM kept, range(8) AS t(p)
), c0 AS MATERIALIZED (
  SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, x AS e FROM parts
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16)
), """
        + ",\n".join(steps)
        + f""",
digest AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, entry)) AS h FROM c{rounds}),
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM coded JOIN kept USING (vec_id), digest
"""
    )


SQL["op11_vector_codes"] = _sql_vector_codes()


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document drawn towards the words of the benchmark."""
    docs = table(session(spark), sf_dir, "documents").select("doc_id", "text")
    drawn = importance.resample(docs, table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


SQL["op12_importance"] = """
WITH bits AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM range(256) AS r(i))
), split AS (
  SELECT 0 AS target, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
), features AS (SELECT target, doc_id, unnest(w) AS word FROM split),
hashed AS MATERIALIZED (
  SELECT word, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(hex(word)), 2), lambda i: CAST('0x' || hex(word)[i : i + 1] AS BIGINT))),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM features), bits
), held AS (
  SELECT b.bucket, count(*) FILTER (WHERE target = 0) AS s, count(*) FILTER (WHERE target = 1) AS t FROM features JOIN hashed AS b USING (word) GROUP BY b.bucket
), whole AS (SELECT CAST(sum(s) AS DOUBLE) AS s_all, CAST(sum(t) AS DOUBLE) AS t_all FROM held),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(((t + CAST(1 AS DOUBLE)) * (s_all + 10000)) / ((s + CAST(1 AS DOUBLE)) * (t_all + 10000)))) AS BIGINT) AS gain FROM held, whole
), sums AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS g FROM features JOIN hashed USING (word) JOIN gains USING (bucket) WHERE target = 0 GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) AS n_features, CASE WHEN len(w) = 0 THEN 0 ELSE (g - ((g % len(w)) + len(w)) % len(w)) // len(w) END AS weight,
         CAST('0x' || left(sha256('2024:' || doc_id), 8) AS BIGINT) AS h
  FROM split LEFT JOIN sums USING (doc_id) WHERE target = 0
), final AS (
  SELECT doc_id, n_features, weight,
         weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM scored
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM final WHERE n_features >= 20
)
SELECT final.doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, r AS rank
FROM final LEFT JOIN ranked ON ranked.doc_id = final.doc_id AND r <= 10 * n // 100
"""


def op13_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to searchable shards in ascending doc_id order and read back."""
    docs = table(session(spark), sf_dir, "documents").select("doc_id", "text")
    folder = token_store.token_folder(spark)
    files = token_store.write(docs, public_tokenizers.path("word_bpe_49k.json"), folder)
    found = token_store.read(files, folder, kind=docs.schema["doc_id"].dataType.simpleString())
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the whole corpus pipeline leaves."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_ann": op2_ann,
    "op3_html": op3_html,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_language_id": op5_language_id,
    "op6_warc": op6_warc,
    "op7_decontaminate": op7_decontaminate,
    "op8_packing": op8_packing,
    "op9_line_dedup": op9_line_dedup,
    "op10_simhash": op10_simhash,
    "op11_vector_codes": op11_vector_codes,
    "op12_importance": op12_importance,
    "op13_token_store": op13_token_store,
    "pipeline": pipeline,
}

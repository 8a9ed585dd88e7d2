"""The registered queries of the numbered operators and their oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from glosswork.llm import bpe, imatch, langid, packing, phrases, pii, quality, sharding, simhash, spelling, topk, vectors, warc
from glosswork.llm.hashing import id_remainder
from glosswork.llm.storage import materialise, new_folder

ACCEPTED_SCORE = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_remainder("doc_id", 5) == 0
    model = quality.train(docs, _table(spark, sf_dir, "labels"), learn=~held_out)
    scored = quality.score(docs, model)
    predicted = (F.col("quality_score") >= ACCEPTED_SCORE).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"), predicted.alias("predicted"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode_documents(_table(spark, sf_dir, "documents"), ranks, with_ids=False)
    return encoded.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    return warc.read_indexed(warc.archive(_table(spark, sf_dir, "pages"), folder), folder)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii_spans", lambda x: x["base"])
    of = lambda name: F.size(F.filter("pii_spans", lambda x: x["kind"] == name)).cast("long").alias(f"n_{name}")
    return found.select(
        "doc_id",
        *[of(k.name) for k in pii.KINDS if k.base],
        F.sha2(pii.joined_spans(base).cast("binary"), 256).alias("base_sha256"),
        pii.joined_spans(F.col("pii_spans")).alias("spans"),
        F.array_join(F.transform("pii_spans", lambda x: x["score"].cast("string")), ",").alias("scores"),
    )


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.col("edited").cast("binary"), 256)
    thin = imatch.fingerprint_with_edits(_table(spark, sf_dir, "documents"), carry={"n_chars": F.length("text").cast("long"), "edited_sha256": digest})
    return thin.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        imatch.fingerprint(F.col("parts")).alias("fingerprint"),
        imatch.fingerprint(F.col("edited_parts")).alias("edited_fingerprint"),
        imatch.likeness(F.col("parts"), F.col("edited_parts")).alias("near_edited"),
        imatch.likeness(F.col("parts"), F.col("next_parts")).alias("near_next"),
    )


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_remainder("doc_id", 4) == 2
    model = langid.train(docs, ~held_out)
    predicted = langid.predict(docs.select("doc_id", "text"), model)
    return predicted.select(
        "doc_id",
        held_out.alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.col("lang_accepted").alias("accepted"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.document_shards(_table(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return placed.select(
        "doc_id", "size", crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("id", "vec_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    packed = packing.pack(pieces)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.top_phrases(_table(spark, sf_dir, "documents"))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


QUERIES = {
    "op1_quality": op1_quality,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_warc": op3_warc,
    "op4_pii": op4_pii,
    "op5_imatch": op5_imatch,
    "op6_language": op6_language,
    "op7_simhash": op7_simhash,
    "op8_sharding": op8_sharding,
    "op9_vectors": op9_vectors,
    "op10_packing": op10_packing,
    "op11_spelling": op11_spelling,
    "op12_phrases": op12_phrases,
    "op13_topk": op13_topk,
}
# The others are learned models, tokenizers, or free choices of places, which SQL cannot express; tests hold them
# against brute-force versions.
ORACLES = {
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first, unhex(sha1(html))::BIT::VARCHAR AS bits FROM p)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
    16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
    + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT)::INT, 1)), '') AS payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to
FROM g""",
    "op9_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id, vec_id AS root FROM v UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.vec_id),
roots AS (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id),
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, r.component_id, r.component_id = v.vec_id AS kept
FROM v JOIN roots r USING (vec_id) LEFT JOIN degrees d ON d.a = v.vec_id""",
    "op11_spelling": r"""
WITH RECURSIVE poly AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(range(9), lambda c, k: CASE WHEN k = 0 THEN c ELSE CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END END, i) AS c
  FROM range(256) AS b(i))),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
kinds AS (SELECT doc_id, run, count(*) AS times FROM runs WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (SELECT doc_id, run, times, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM kinds),
hashed AS (SELECT run, times, xor(4294967295, list_reduce(range(length(x) // 2),
             lambda c, i: xor(c // 256, t[1 + xor(c % 256, ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)]), 4294967295)) AS h FROM bytes, poly),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
holes AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word AS a, b.word AS b, b.n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON h.rest = w.word
  UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON h.rest = w.word),
best AS (SELECT a, count(*) AS n_near, max(n) AS most FROM near GROUP BY a),
top AS (SELECT near.a, n_near, most, min(b) AS b FROM best JOIN near ON near.a = best.a AND n = most GROUP BY ALL),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * n THEN b END AS form, CASE WHEN most >= 10 * n THEN most END AS form_n
           FROM words LEFT JOIN top ON a = word),
walk AS (SELECT word, word AS at FROM formed UNION ALL SELECT walk.word, f.form FROM walk JOIN formed f ON f.word = walk.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN walk w ON w.word = f.word JOIN formed e ON e.word = w.at AND e.form IS NULL""",
    "op12_phrases": r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT d, lang, unnest(ps) AS piece, generate_subscripts(ps, 1) AS p
           FROM (SELECT d, lang, string_split_regex(t, '[.,;:!?\x0A-\x0D]') AS ps FROM docs)),
words AS (SELECT lang, d, p, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
          FROM (SELECT d, lang, p, regexp_extract_all(piece, '[^ \t]+') AS ws FROM pieces)),
runs AS (SELECT lang, w AS w1, lead(w, 1) OVER s AS w2, lead(w, 2) OVER s AS w3, lead(w, 3) OVER s AS w4
         FROM words WINDOW s AS (PARTITION BY d, p ORDER BY i)),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, [w1] AS ws, count(*) AS f FROM runs GROUP BY ALL UNION ALL
  SELECT lang, [w1, w2], count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY ALL UNION ALL
  SELECT lang, [w1, w2, w3], count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY ALL UNION ALL
  SELECT lang, [w1, w2, w3, w4], count(*) FROM runs WHERE w4 IS NOT NULL GROUP BY ALL),
known AS (SELECT lang, ws, f::HUGEINT AS f FROM grams WHERE f >= 30),
cuts AS (SELECT c.lang, c.ws, c.f AS a, k, l.f AS l, r.f AS r, 2000000 * c.f // (l.f + r.f) AS score
         FROM (SELECT *, unnest(range(1, len(ws))) AS k FROM known WHERE len(ws) > 1) c
         JOIN known l ON l.lang = c.lang AND l.ws = c.ws[1:k] JOIN known r ON r.lang = c.lang AND r.ws = c.ws[k + 1:]),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
held AS (SELECT lang, part, max(f) AS f FROM (
    SELECT lang, f, unnest(list_distinct([ws[1:2], ws[2:3], ws[3:4], ws[1:3], ws[2:4]])) AS part, ws FROM known WHERE len(ws) > 2)
  WHERE len(part) > 1 AND len(part) < len(ws) GROUP BY ALL),
kept AS (SELECT c.*, array_to_string(c.ws, ' ') AS phrase FROM lowest c LEFT JOIN held h ON h.lang = c.lang AND h.part = c.ws
         WHERE h.f IS NULL OR 100 * h.f < 80 * c.a),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::INTEGER AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM placed JOIN totals USING (lang) WHERE rank <= 2000""",
    "op13_topk": """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
          FROM v q JOIN v c ON q.row <> c.row AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) <= 5""",
}

"""The registered queries of this subpackage, and SQL for those that SQL can state."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeweft.llm import (
    byte_bpe, collocations, hamming, lang_id, main_text, near_dedup, packing, posting_lists, quality, rans, repair,
    token_counts, warc)
from tradeweft.llm.common import table

#: Id put after each document by queries 3 and 5.
END = 2


def op1_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.link(table(spark, folder, "documents"))


def op2_hamming_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return hamming.top_k(table(spark, folder, "embeddings"), every=100, k=10)


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    rows = rans.round_trip(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), END)
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = byte_bpe.RankMap(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    coded = byte_bpe.encode(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)
    decimal = F.btrim(F.to_json("ids"), F.lit("[]"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
                        F.sha2(byte_bpe.decode(F.col("ids"), ranks), 256).alias("decoded_sha256"))


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END)


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return lang_id.identify(documents, lang_id.train(documents))


def op8_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return main_text.extract(pages, main_text.train(pages))


def op9_posting_lists(spark: SparkSession, folder: str) -> DataFrame:
    return posting_lists.search(table(spark, folder, "embeddings"), every=20, k=20)


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"), words=3, least=10, inside=50, top=2000)


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair(table(spark, folder, "conversations"))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_hamming_top_k, op3_token_files, op4_byte_bpe, op5_best_fit_packing,
                                   op6_warc, op7_language_id, op8_main_text, op9_posting_lists, op10_quality, op11_token_counts,
                                   op12_collocations, op13_conversation_repair)}

ORACLES = {
    "op1_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE doc_id IS NOT NULL),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS x
  FROM w),
e AS (SELECT doc_id, len(x) AS n, unnest(x) AS x FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b USING (x)
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id, doc_id AS low FROM s UNION SELECT links.b, reach.low FROM reach JOIN links ON links.a = reach.doc_id)
SELECT s.doc_id, CAST(len(any_value(s.x)) AS BIGINT) AS n_shingles, min(low) AS component_id, s.doc_id = min(low) AS kept
FROM s JOIN reach USING (doc_id) GROUP BY s.doc_id""",
    "op2_hamming_top_k": """
WITH c AS (
  SELECT vec_id, list_transform(embedding[1:64], lambda x: x > 0) AS b FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
d AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.b, v.b),
           lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM c q JOIN c v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance
FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 10""",
    "op12_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f1 AS (SELECT lang, w[i] AS w1, count(*) AS a FROM t GROUP BY ALL),
f2 AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, count(*) AS a FROM t WHERE i + 1 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*) AS a FROM t WHERE i + 2 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f1 GROUP BY lang),
cuts AS (
  SELECT p.lang, concat_ws(' ', p.w1, p.w2) AS phrase, p.a, 1 AS k, x.a AS l, y.a AS r
  FROM f2 p JOIN f1 x ON p.lang = x.lang AND p.w1 = x.w1 JOIN f1 y ON p.lang = y.lang AND p.w2 = y.w1
  LEFT JOIN (SELECT lang, w1, w2, max(a) AS a FROM (
    SELECT lang, w1, w2, a FROM f3 UNION ALL SELECT lang, w2, w3, a FROM f3) GROUP BY ALL) z
    ON p.lang = z.lang AND p.w1 = z.w1 AND p.w2 = z.w2
  WHERE z.a IS NULL OR 100 * z.a < 50 * p.a
  UNION ALL
  SELECT p.lang, concat_ws(' ', p.w1, p.w2, p.w3), p.a, 1, x.a, y.a
  FROM f3 p JOIN f1 x ON p.lang = x.lang AND p.w1 = x.w1 JOIN f2 y ON p.lang = y.lang AND p.w2 = y.w1 AND p.w3 = y.w2
  UNION ALL
  SELECT p.lang, concat_ws(' ', p.w1, p.w2, p.w3), p.a, 2, x.a, y.a
  FROM f3 p JOIN f2 x ON p.lang = x.lang AND p.w1 = x.w1 AND p.w2 = x.w2 JOIN f1 y ON p.lang = y.lang AND p.w3 = y.w1),
s AS (SELECT *, CAST(CAST(a AS HUGEINT) * a * 1000000 // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
one AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT one.lang, row_number() OVER (PARTITION BY one.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n.n, score
FROM one JOIN n ON one.lang = n.lang
QUALIFY row_number() OVER (PARTITION BY one.lang ORDER BY score DESC, a DESC, phrase) <= 2000""",
    "op6_warc": """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages WHERE page_id IS NOT NULL),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN top END AS refers_to
FROM g""",
}

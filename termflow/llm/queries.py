"""The queries of the subpackage, one for each operator, with SQL twins where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (byte_bpe, chat, decontaminate, html_extract, langid, mining_queries, pivots, simhash, token_store, toxicity,
               url_filter)
from .common import held_out, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def byte_tokens(docs: DataFrame) -> DataFrame:
    ids = docs.select("doc_id", byte_bpe.encode(F.col("text"), RANKS, public_tokenizers.PATTERN).alias("ids"))
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(byte_bpe.decode(F.col("ids"), RANKS, public_tokenizers.PATTERN), 256).alias("decoded_sha256"))


def byte_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_tokens(table(spark, sf_dir, "documents"))


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(chat.with_other_replies(table(spark, sf_dir, "conversations")))


def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    crf = langid.fit(docs, ~held_out(F.col("doc_id")))
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                        langid.predict(F.col("text"), crf, spark).alias("p"))
            .select("doc_id", "held_out", "p.lang_pred", "p.score"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"))


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                        toxicity.score(F.col("text"), model, spark).alias("score"))
            .withColumn("predicted", F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0)))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stored_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_digests(token_store.write_tokens(table(spark, sf_dir, "documents"), WORD_BPE, END_ID))


_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)

URLS_SQL = rf"""
WITH rules(h, p, v) AS (VALUES {_RULES_SQL}),
parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
numbered AS (SELECT *, row_number() OVER () AS n FROM parts),
best AS (
  SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM numbered JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY n)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM numbered LEFT JOIN best USING (n)
"""

PREFERENCES_SQL = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
         '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line FROM turns),
lasts AS (
  SELECT conv_id, max(k) FILTER (role = 'assistant') AS last, count(*) AS n FROM placed GROUP BY conv_id
  HAVING max(k) FILTER (role = 'assistant') IS NOT NULL),
replies AS (SELECT l.*, text AS reply FROM lasts l JOIN placed p ON p.conv_id = l.conv_id AND p.k = l.last),
pairs AS (
  SELECT a.*, b.conv_id AS other_id, b.reply AS other, CASE WHEN a.reply = b.reply THEN a.n ELSE a.last - 1 END AS common
  FROM replies a JOIN replies b ON b.conv_id = xor(a.conv_id, 1)),
lines AS (
  SELECT p.*, k, line AS c, CASE WHEN k = last THEN '<|assistant|>' || chr(10) || other || '<|end|>' || chr(10) ELSE line END AS r,
         CASE WHEN role = 'assistant' THEN '1:' ELSE '0:' END AS m
  FROM pairs p JOIN placed USING (conv_id))
SELECT conv_id AS pair_id, conv_id AS chosen_id, other_id AS rejected_id, common AS prompt_turns,
       coalesce(string_agg(c, '' ORDER BY k) FILTER (k <= common), '') AS prompt,
       coalesce(string_agg(c, '' ORDER BY k) FILTER (k > common), '') AS chosen,
       coalesce(string_agg(m || length(c), ',' ORDER BY k) FILTER (k > common), '') AS chosen_mask,
       coalesce(string_agg(r, '' ORDER BY k) FILTER (k > common), '') AS rejected,
       coalesce(string_agg(m || length(r), ',' ORDER BY k) FILTER (k > common), '') AS rejected_mask
FROM lines GROUP BY conv_id, other_id, common
"""

QUERIES = {
    "op1_greedy_string_tiling": decontamination,
    "op2_byte_bpe": byte_encoding,
    "op3_preference_formatting": preferences,
    "op4_wrapper_induction": main_text,
    "op5_crf_language_id": languages,
    "op6_pivot_permutation": vectors,
    "op7_nb_toxicity": toxic,
    "op8_blocked_bloom_urls": urls,
    "op9_pigeonring_simhash": near_documents,
    "op10_arrow_token_store": stored_tokens,
    **mining_queries.QUERIES,
}

ORACLES = {"op3_preference_formatting": PREFERENCES_SQL, "op8_blocked_bloom_urls": URLS_SQL, **mining_queries.ORACLES}

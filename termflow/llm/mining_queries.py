"""Queries of the mixing, repair and mining operators, with SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives, source_mix, turn_repair
from .common import table


def source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents"))


def repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repairs(turn_repair.damaged(table(spark, sf_dir, "conversations")))


def hard_negative_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved))


REPAIR_SQL = r"""
WITH RECURSIVE marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(cast(conv_id AS varchar), ' ') || ':' || coalesce(cast(turn AS varchar), ' ') AS k FROM conversations),
-- crc32, bit by bit: a step of eight shifts for each byte of the key
bits(k, i, c) AS (
  SELECT DISTINCT k, 0, 4294967295::bigint FROM marked
  UNION ALL
  SELECT k, i + 1, list_reduce(list_prepend(xor(c, ascii(substr(k, i + 1, 1))::bigint), range(8)),
                               lambda a, b: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))
  FROM bits WHERE i < length(k)),
faults AS (SELECT k, xor(c, 4294967295) % 20 AS fault FROM bits WHERE i = length(k)),
rows_ AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM marked JOIN faults USING (k), LATERAL unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END)
  WHERE fault <> 0),
numbered AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || ':' || text)) AS n
  FROM rows_),
placed AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY n) AS before, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS e,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again FROM numbered),
judged AS MATERIALIZED (
  SELECT *, e = '' AS blank, e <> '' AND again AS dup, e <> '' AND NOT again AND right(e, 1) NOT IN ('.', '!', '?') AS cut,
         before IS NOT NULL AND (left(before, 1) || left(role, 1)) NOT IN ('su', 'ua', 'au') AS bad FROM placed),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (bad) AS illegal FROM judged GROUP BY conv_id),
-- edits of one kind in a state; then the state after them
legal(p, r, q) AS (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
fill(p, q, name) AS (VALUES ('', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')),
inserts(p, q, c, s, t) AS (
  SELECT DISTINCT p, p, 0, '', '' FROM fill UNION ALL SELECT p, q, 2, 'I', chr(10) || name || ':' FROM fill
  UNION ALL SELECT a.p, b.q, 4, 'II', chr(10) || a.name || ':' || chr(10) || b.name || ':' FROM fill a JOIN fill b ON a.q = b.p),
walk(conv_id, i, p, cost, audit, made) AS (
  SELECT conv_id, 0, '', 0, '', '' FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, b.q, min(b.cost), arg_min(b.audit, (b.cost, b.audit)), arg_min(b.made, (b.cost, b.audit)) FROM (
    SELECT w.conv_id, w.i + 1 AS i, x.q, w.cost + n.c + x.c AS cost, w.audit || n.s || x.s AS audit, w.made || n.t || x.t AS made
    FROM walk w JOIN inserts n ON n.p = w.p JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.n = w.i + 1,
    LATERAL (
      SELECT n.q, 3 AS c, 'D' AS s, '' AS t
      UNION ALL SELECT l.q, CASE WHEN j.cut THEN 1 ELSE 0 END, 'K', chr(10) || j.role || ':' || j.text FROM legal l
        WHERE l.p = n.q AND l.r = left(j.role, 1) AND NOT j.blank AND NOT j.dup
      UNION ALL SELECT f.q, 2 + CASE WHEN j.cut THEN 1 ELSE 0 END, 'R', chr(10) || f.name || ':' || j.text FROM fill f
        WHERE f.p = n.q AND NOT j.blank AND NOT j.dup) x) b
  GROUP BY conv_id, i, b.q),
ends AS (
  SELECT w.conv_id, min((w.cost + n.c, w.audit || n.s, w.made || n.t)) AS b
  FROM walk w JOIN inserts n ON n.p = w.p LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id
  WHERE w.i = coalesce(c.n, 0) AND n.q IN ('', 'a') GROUP BY w.conv_id)
SELECT e.conv_id, cast(coalesce(gaps, 0) AS bigint) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cast(b[1] AS bigint) AS cost, b[2] AS audit,
       sha256(substr(b[3], 2)) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""

MINING_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::bigint + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::double)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
anchors AS (SELECT * FROM usable WHERE vec_id % 50 = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, cast(list_inner_product(a.v, b.v) AS bigint) AS score
  FROM anchors a JOIN usable b ON a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, cast(row_number() OVER w AS integer) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scores s USING (anchor_id)
WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
"""

QUERIES = {
    "op11_cube_mix": source_mixture,
    "op12_survivor_viterbi": repaired_conversations,
    "op13_str_rtree_negatives": hard_negative_rows,
}

ORACLES = {"op12_survivor_viterbi": REPAIR_SQL, "op13_str_rtree_negatives": MINING_SQL}

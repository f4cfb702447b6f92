"""Corpus pipeline: language, toxicity, near duplicates, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; run() writes every
stage as Parquet in the shared folder and rereads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termflow.llm import decontaminate, langid, shingles, toxicity
from termflow.llm.common import held_out, table
from termflow.llm.queries import byte_tokens
from termflow.session import written

#: A document goes if no language reaches this mean probability over its words.
LANGUAGE_SCORE = 0.4


def fresh(docs: DataFrame, name: str) -> str:
    """The name, longer where the table has it already."""
    while name in map(str.lower, docs.columns):
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a recognized language; no text, no letter or no clear language goes."""
    crf = langid.fit(docs, ~held_out(F.col("doc_id")))
    p = fresh(docs, "_p")
    scored = docs.withColumn(p, langid.predict(F.col("text"), crf, spark))
    return scored.where((F.col(p)["lang_pred"] != langid.UNKNOWN) & (F.col(p)["score"] >= LANGUAGE_SCORE)).drop(p)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier takes for toxic; it learns from the labels of what came in."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    s = fresh(docs, "_s")
    return docs.withColumn(s, toxicity.score(F.col("text"), model, spark)).where(F.col(s) < toxicity.THRESHOLD).drop(s)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every group, the one with the smallest id. Documents are linked by op9's fingerprints,
    found by pigeonring filtering, and, as these miss most near copies, at a 5-word Jaccard of 0.8 too."""
    return shingles.one_of_each(docs, fingerprints=True)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that cover a benchmark item."""
    leaks = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level token ids of what is left, as digests, with the decoded bytes."""
    return byte_tokens(docs)


STAGES = [("language", language), ("toxicity", not_toxic), ("near_duplicates", one_of_each_group),
          ("benchmark", clean_of_benchmark), ("tokens", token_ids)]

#: No stage but the last two could be said in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

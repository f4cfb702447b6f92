"""Language detection from word profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def word_profiles(docs: DataFrame) -> DataFrame:
    """All words of every labelled language with their log share, as whole numbers so that scores do
    not depend on the order of summation."""
    words = docs.select("lang", F.explode_outer(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))).alias("word")).where("word is not null")
    n = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    total = n.groupBy("lang").agg(F.sum("n").alias("total"))
    return n.join(total, "lang").select(F.col("lang").alias("guess"), "word", (F.round(F.log(F.col("n") / F.col("total")) * 1000) + 12000).cast("bigint").alias("weight"))


def detect(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(doc_id, guess): the language whose profile words weigh most; texts without any are `en`.

    Each distinct word of a document meets at most one row per language.
    """
    from ..skew import salted_join
    words = docs.select("doc_id", F.explode_outer(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))).alias("word")).where("word is not null")
    counts = words.groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    score = (salted_join(counts, profiles, ["word"], ["doc_id"])
             .groupBy("doc_id", "guess").agg(F.sum(F.col("n") * F.col("weight")).alias("score")))
    best = score.groupBy("doc_id").agg(F.max_by("guess", F.struct("score", "guess")).alias("guess"))
    return docs.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("guess", F.lit("en")).alias("guess"))


def accuracy(guesses: DataFrame, truth: DataFrame) -> DataFrame:
    return truth.select("doc_id", "lang").join(guesses, "doc_id").groupBy("lang", "guess").agg(F.count("*").alias("n"))

"""Glossary adherence of translated blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..skew import salted_join
from .matching import term_hits


def empty_translations(blocks: DataFrame) -> DataFrame:
    return blocks.where(T.strip(F.coalesce("translated_text", F.lit(""))) == "")


def adherence(blocks: DataFrame, expectations: DataFrame) -> DataFrame:
    """For every block that contains a source term: does its translation contain the target?

    expectations: id, source, expected. Blocks need doc_id, block_no, source_text, translated_text.
    """
    e = expectations.where("expected <> ''").withColumn("term", F.lower("source"))
    hits = salted_join(term_hits(blocks, e.select("term")).select("doc_id", "block_no", "term"),
                       e.select("term", "id", F.lower("expected").alias("_want")), ["term"], ["doc_id", "block_no"])
    rest = blocks.select("doc_id", "block_no", *[c for c in blocks.columns if c not in ("doc_id", "block_no", "source_text")])
    j = hits.join(rest, ["doc_id", "block_no"])
    return j.withColumn("kept", F.contains(F.lower(F.coalesce("translated_text", F.lit(""))), F.col("_want"))).drop("_want")


def adherence_rates(checked: DataFrame, keys: list[str]) -> DataFrame:
    return checked.groupBy(*keys).agg(F.count("*").alias("n_expected"), F.count_if("kept").alias("n_kept"),
                                      F.avg(F.col("kept").cast("double")).alias("rate"))

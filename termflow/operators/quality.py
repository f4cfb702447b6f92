"""Checks over translated blocks and over quality scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T


def placeholder_parity(df: DataFrame, source: str, target: str) -> DataFrame:
    """Rows whose placeholders differ between source and translation."""
    a, b = T.placeholders(F.col(source)), T.placeholders(F.col(target))
    out = (df.withColumn("expected", F.size(a))
           .withColumn("missing", F.array_join(F.array_sort(F.array_except(a, b)), " "))
           .withColumn("added", F.array_join(F.array_sort(F.array_except(b, a)), " ")))
    return out.where("missing <> '' or added <> ''")


def rebuild_categories(source: DataFrame, output: DataFrame, keys: list[str], mark: str = "[T]") -> DataFrame:
    """Compare source and output blocks: parity, kept blanks, unchanged, translated, lost."""
    s = source.select(*keys, F.col("source_text").alias("s"), F.lit(True).alias("in_source"))
    o = output.select(*keys, F.col("output_text").alias("o"), F.lit(True).alias("in_output"))
    blank = lambda c: T.strip(F.col(c)) == ""
    cat = (F.when(F.col("in_output").isNull(), "lost").when(F.col("in_source").isNull(), "invented")
           .when(blank("s") & blank("o"), "blank_kept").when(blank("s"), "blank_filled")
           .when(F.col("s") == F.col("o"), "unchanged")
           .when(F.contains("o", F.concat(F.lit(mark), T.strip(F.col("s")))), "translated")
           .when(F.contains("o", F.lit(mark)), "translated_loosely").otherwise("unmarked"))
    return s.join(o, keys, "full").withColumn("category", cat).groupBy("category").agg(F.count("*").alias("n"))


def group_spans(segments: DataFrame) -> DataFrame:
    """First and last segment of every visual group; they differ only for a split group."""
    return (segments.where("group_id is not null").groupBy("doc_id", "group_id")
            .agg(F.min("segment_no").alias("lo"), F.max("segment_no").alias("hi")))


def run_averages(results: DataFrame) -> DataFrame:
    return results.groupBy("run_id").agg(F.avg("overall").alias("average_overall"),
                                         F.count("*").alias("n_results"))


def compare_latest(runs: DataFrame, order: list[str]) -> DataFrame:
    """The two newest runs side by side; nothing when there are fewer than two."""
    keys = F.struct(*order)
    newest = runs.orderBy(*[F.desc(c) for c in order]).limit(2)
    return (newest.agg(F.max_by("run_id", keys).alias("current_run"), F.max_by("average_overall", keys).alias("current_average"),
                       F.min_by("run_id", keys).alias("previous_run"), F.min_by("average_overall", keys).alias("previous_average"),
                       F.count("*").alias("n"))
            .where("n = 2").drop("n")
            .withColumn("delta", F.col("current_average") - F.col("previous_average"))
            .withColumn("improved", F.col("delta") > 0)
            .withColumn("regressed", F.col("delta") < K.REGRESSION_DROP))

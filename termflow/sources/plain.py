"""Plain text and Markdown files as blocks. Lines stay in the row of their file, so islands of
lines are found without moving anything."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import constants as K
from ..functions import text as T


@F.pandas_udf(ArrayType(IntegerType()))
def running_count(flags: pd.Series) -> pd.Series:
    """Running number of true flags in each array."""
    return flags.map(lambda a: np.cumsum(np.asarray(a, dtype=np.int32)))


def _islands(lines: Column, inside: Column, kind: str) -> Column:
    """Maximal runs of lines whose flag in `inside` is true, as array<struct<line, span, text, type>>."""
    index = F.sequence(F.lit(0), F.size(lines))

    def edges(flags):
        at = lambda i: F.coalesce(F.get(flags, i), F.lit(False))
        starts = F.filter(index, lambda i: at(i) & ((i == 0) | ~at(i - 1)))
        ends = F.filter(index, lambda i: at(i) & ~at(i + 1))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    return F.transform(T.let(inside, edges), lambda z: F.struct(
        z["a"].alias("line"), (z["b"] - z["a"] + 1).alias("span"),
        T.strip(F.array_join(F.slice(lines, z["a"] + 1, z["b"] - z["a"] + 1), "\n")).alias("text"), F.lit(kind).alias("type"),
        F.lit("").alias("prefix")))


def txt_blocks(files: DataFrame) -> DataFrame:
    """Paragraphs between blank lines, with their first line and line count."""
    staged = files.select("doc_id", T.file_lines(F.col("text")).alias("lines")).withColumn(
        "filled", F.transform("lines", lambda l: T.strip(l) != ""))
    rows = staged.select("doc_id", F.explode_outer(_islands(F.col("lines"), F.col("filled"), "paragraph")).alias("p")).select("doc_id", "p.*")
    return rows.where(T.is_translatable(F.col("text"))).select(
        "doc_id", F.concat(F.lit("para_"), "line").alias("block_id"), "line", "span", F.col("text").alias("source_text"))


def md_blocks(files: DataFrame) -> DataFrame:
    """Headings, list items and paragraphs outside code fences."""
    lines = F.col("lines")
    f = files.select("doc_id", T.file_lines(F.col("text")).alias("lines"))
    f = f.withColumn("fence", F.transform("lines", lambda l: F.regexp_like(T.strip(l), F.lit("^(?:```|~~~)"))))
    f = f.withColumn("fences", running_count("fence"))
    role = F.transform(lines, lambda l, i: F.when(F.get("fence", i), "fence").when(F.get("fences", i) % 2 == 1, "code")
                       .when(F.regexp_like(l, F.lit(K.MD_HEADING)), "heading").when(F.regexp_like(l, F.lit(K.MD_LIST)), "list")
                       .when(T.strip(l) == "", "blank").otherwise("paragraph"))
    f = f.withColumn("role", role)
    single = F.filter(F.transform(lines, lambda l, i: F.struct(
        i.alias("line"), F.lit(1).alias("span"),
        T.strip(F.regexp_extract(l, K.MD_HEADING, 2)).alias("h"), T.strip(F.regexp_extract(l, K.MD_LIST, 2)).alias("li"),
        F.get("role", i).alias("type"),
        F.when(F.get("role", i) == "heading", F.regexp_extract(l, K.MD_HEADING, 1)).otherwise(F.regexp_extract(l, K.MD_LIST, 1)).alias("prefix"))),
        lambda s: s["type"].isin("heading", "list"))
    ones = F.transform(single, lambda s: F.struct(s["line"].alias("line"), s["span"].alias("span"), F.when(
        s["type"] == "heading", s["h"]).otherwise(s["li"]).alias("text"), s["type"].alias("type"), s["prefix"].alias("prefix")))
    paras = _islands(lines, F.transform("role", lambda r: r == "paragraph"), "paragraph")
    rows = f.select("doc_id", F.explode_outer(F.concat(ones, paras)).alias("b")).select("doc_id", "b.*").where(T.is_translatable(F.col("text")))
    head = F.when(F.col("type") == "heading", F.concat(F.lit("h"), F.length("prefix"), F.lit("_"))).when(
        F.col("type") == "list", "li_").otherwise("para_")
    return rows.select("doc_id", F.concat(head, "line").alias("block_id"), "type", "line", "span", "prefix", F.col("text").alias("source_text"))


def rebuild_lines(files: DataFrame, blocks: DataFrame, markdown: bool = False) -> DataFrame:
    """Files with translated blocks written over their lines; other lines stay.

    blocks: doc_id, type, line, span, prefix, source_text, best_text. The blocks of a file travel as
    one map keyed by line, no longer than the file itself.
    """
    mark = F.when(F.col("type") == "heading", F.concat("prefix", F.lit(" "))).when(F.col("type") == "list", F.col("prefix")).otherwise("")
    changed = blocks.where("best_text <> source_text").select("doc_id", "line", "span", F.concat(
        mark if markdown else F.lit(""), "best_text").alias("new"))
    # Further lines of a paragraph: blanked in plain text, dropped in Markdown.
    touched = changed.select("doc_id", F.posexplode(F.sequence(F.col("line"), F.col("line") + F.col("span") - 1)).alias("k", "at"), "new").select(
        "doc_id", "at", F.when(F.col("k") == 0, F.col("new")).otherwise(F.lit(None if markdown else "")).alias("new"))
    packed = touched.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct("new")))).alias("m"))
    empty = F.create_map().cast("map<int,struct<new:string>>")
    j = files.join(packed, "doc_id", "left").withColumn("m", F.coalesce("m", empty)).withColumn("lines", T.file_lines(F.col("text")))
    body = F.filter(F.transform("lines", lambda l, i: F.when(F.map_contains_key(F.col("m"), i), F.element_at("m", i)["new"]).otherwise(l)),
                    lambda l: l.isNotNull())
    tail = F.when(F.col("text").endswith("\n"), "\n").otherwise("")
    return j.select("doc_id", F.concat(F.array_join(body, "\n"), tail).alias("text"))

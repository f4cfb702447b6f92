"""Subtitle files as cue blocks. A file is one row (doc_id, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

ARROW = r"(\d+:\d+:\d+[,.]\d+|\d+:\d+[.]\d+)\s*-->\s*(\d+:\d+:\d+[,.]\d+|\d+:\d+[.]\d+)"


def _paragraphs(text: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(text, r"^\x{feff}", ""), r"\r\n|\r", "\n")
    return F.filter(F.split(body, r"\n[ \t]*\n"), lambda p: F.regexp_like(p, F.lit(ARROW)))


def _cue(p: Column) -> Column:
    """Index, times and text of one paragraph; its text is everything below the arrow line."""
    return F.struct(
        F.regexp_extract(p, r"^\s*(\d+)[ \t]*\n", 1).try_cast("int").alias("cue"),
        F.regexp_extract(p, ARROW, 1).alias("start"), F.regexp_extract(p, ARROW, 2).alias("end"),
        T.strip(F.regexp_extract(p, rf"(?s){ARROW}[^\n]*\n?(.*)$", 3)).alias("text"))


def srt_blocks(files: DataFrame) -> DataFrame:
    cues = F.transform(_paragraphs(F.col("text")), _cue)
    return (files.select("doc_id", F.posexplode_outer(cues).alias("block_no", "c")).where("c.text <> ''")
            .select("doc_id", "block_no", F.concat(F.lit("srt_"), "c.cue").alias("block_id"), "c.cue", "c.start", "c.end",
                    F.col("c.text").alias("source_text")))


def vtt_blocks(files: DataFrame) -> DataFrame:
    """Cues count from zero; the header, notes and styles carry no arrow line and drop out."""
    long_time = lambda c: F.when(c.rlike(r"^\d+:\d+\.\d+$"), F.concat(F.lit("00:"), c)).otherwise(c)
    cues = F.transform(_paragraphs(F.col("text")), _cue)
    return (files.select("doc_id", F.posexplode_outer(cues).alias("block_no", "c")).where("c.text <> ''")
            .select("doc_id", "block_no", F.concat(F.lit("vtt_"), "block_no").alias("block_id"), F.col("block_no").alias("cue"),
                    long_time(F.col("c.start")).alias("start"), long_time(F.col("c.end")).alias("end"), F.col("c.text").alias("source_text")))


DEFAULT_FORMAT = "layer,start,end,style,name,marginl,marginr,marginv,effect,text"


def ass_lines(files: DataFrame) -> DataFrame:
    """Event lines of every file with its column count and the position of its text column."""
    is_format = lambda l: F.lower(T.strip(l)).startswith("format:")
    section = F.regexp_extract(F.regexp_replace("text", r"\r\n|\r", "\n"), r"(?is)(?:\A|\n)[ \t]*\[events\][ \t]*\n(.*)\z", 1)
    rows = files.select("doc_id", F.filter(F.split(section, "\n"), lambda l: T.strip(l) != "").alias("rows"))
    fmt = rows.withColumn("fmt", F.regexp_replace(T.strip(F.try_element_at(F.filter("rows", is_format), F.lit(-1))), r"(?i)^format:", ""))
    named = fmt.withColumn("names", F.transform(F.split(F.coalesce("fmt", F.lit(DEFAULT_FORMAT)), ","), lambda n: F.lower(T.strip(n))))
    at = F.array_position("names", F.lit("text"))
    return named.select("doc_id", F.size("names").alias("n_cols"), F.when(at > 0, at).otherwise(F.size("names")).cast("int").alias("text_col"),
                        F.posexplode_outer(F.filter("rows", lambda l: ~is_format(l))).alias("block_no", "line")).where("line is not null")


def ass_blocks(files: DataFrame) -> DataFrame:
    """Dialogue texts without style tags; rows with too few columns are skipped."""
    parts = F.split(F.col("line"), ",", F.col("n_cols"))
    text = T.strip(F.regexp_replace(F.get(parts, F.col("text_col") - 1), r"\{[^}]*\}", ""))
    return (ass_lines(files).where(F.lower("line").startswith("dialogue:") & (F.size(parts) >= F.col("n_cols")))
            .select("doc_id", "block_no", F.concat(F.lit("ass_"), "block_no").alias("block_id"), text.alias("source_text"))
            .where("source_text <> ''"))


# --- writing them back ------------------------------------------------------------------------

def srt_text(cues: Column) -> Column:
    """A file from array<struct<cue, start, end, text>>."""
    return F.array_join(F.transform(cues, lambda c: F.concat_ws(
        "\n", c["cue"].cast("string"), F.concat(c["start"], F.lit(" --> "), c["end"]), T.strip_line_ends(c["text"]), F.lit(""))), "\n")


def vtt_text(cues: Column) -> Column:
    return F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(cues, lambda c: F.concat_ws(
        "\n", F.concat(c["start"], F.lit(" --> "), c["end"]), T.strip_line_ends(c["text"]), F.lit(""))), "\n"))


def ass_line(line: Column, n_cols: Column, text_col: Column, source: Column, best: Column) -> Column:
    """An event line with its text replaced; leading tags stay, unchanged text leaves the line alone."""
    parts = F.split(line, ",", n_cols)
    raw = F.get(parts, text_col - 1)
    tags = F.regexp_extract(raw, r"^((?:\{[^}]*\})*)", 1)
    new = F.array_join(F.transform(parts, lambda p, i: F.when(i == text_col - 1, F.concat(tags, T.strip_line_ends(best))).otherwise(p)), ",")
    return F.when(best.isNull() | (best == source), line).otherwise(new)

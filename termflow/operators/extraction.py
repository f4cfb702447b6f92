"""Cleaning of extracted terms, in the order the steps must run."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import maps as M
from ..functions import text as T


def count_in_own_document(terms: DataFrame, docs: DataFrame) -> DataFrame:
    """Frequency of every extracted term in its own document.

    The terms of a document come from one reply, so they travel as one array to the text and
    the text is read once, whatever their number.
    """
    cols = [c for c in terms.columns if c != "doc_id"]
    packed = terms.groupBy("doc_id").agg(F.collect_list(F.struct(*cols)).alias("terms"))
    n = T.occurrences_in_text(F.col("_text"), F.transform("terms", lambda t: F.lower(t["source"])))
    counted = packed.join(docs.select("doc_id", F.lower("text").alias("_text")), "doc_id").select(
        "doc_id", "terms", n.alias("_n")).select("doc_id", F.explode_outer(F.arrays_zip("terms", "_n")).alias("t"))
    return counted.select("doc_id", *[F.col(f"t.terms.{c}").alias(c) for c in cols if c != "frequency"], F.col("t._n").alias("frequency"))


def clean_terms(terms: DataFrame, languages: Column) -> DataFrame:
    """Drop terms that are not in the text, blank wrong-script targets, backfill, then drop
    kept-as-is terms that need no decision."""
    keep = F.col("do_not_translate") if "do_not_translate" in terms.columns else F.lit(False)
    out = terms.where("frequency > 0")
    out = out.withColumn("targets", M.clear_wrong_script(F.col("targets"), keep))
    out = out.withColumn("targets", M.backfill(F.col("targets"), languages, F.col("source"), F.col("strategy")))
    return out.where(M.has_translation_value(F.col("targets"), F.col("source"), F.col("strategy")))


def _close(a: str, b: str) -> bool:
    """Edit distance at most one."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    short, long = sorted((a, b), key=len)
    at = next((i for i, ch in enumerate(short) if ch != long[i]), len(short))
    return short[at + (len(short) == len(long)):] == long[at + 1:]


def prune_asr_duplicates(terms: DataFrame) -> DataFrame:
    """Sequential pruning of short all-caps terms that are one edit apart.

    The rule depends on the order of the pairs, so it runs as a small function on the short
    all-caps terms of one reply. Those are words of at most four capitals, kept as arrays.
    """

    @F.pandas_udf("array<int>")
    def losers(words: pd.Series, freqs: pd.Series) -> pd.Series:
        def one(w, n):
            gone: set[int] = set()
            for i in range(len(w)):
                if i in gone:
                    continue
                for j in range(i + 1, len(w)):
                    if j not in gone and _close(w[i], w[j]):
                        gone.add(j if n[i] >= n[j] else i)
            return sorted(gone)
        return pd.Series([one(list(w), list(n)) for w, n in zip(words, freqs)])

    short = (F.length("source") <= 4) & (F.upper("source") == F.col("source")) & (F.lower("source") != F.col("source"))
    packed = (terms.where(short).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "source", "frequency"))).alias("t")))
    beaten = packed.select("doc_id", F.col("t.pos").alias("pos"), losers("t.source", "t.frequency").alias("lost")).select(
        "doc_id", F.explode(F.transform("lost", lambda i: F.get("pos", i))).alias("pos"))
    return terms.join(beaten, ["doc_id", "pos"], "left_anti")


def request_text(docs: DataFrame, acronyms: DataFrame, languages: list[str]) -> DataFrame:
    """Prompt body for term extraction: languages, text, and the acronym hint when there is one."""
    hints = acronyms.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct((-F.col("n")).alias("n"), "acronym"))), lambda a: a["acronym"]), ", ").alias("hint"))
    joined = docs.join(hints, "doc_id", "left")
    body = F.concat(F.lit("Source language: "), F.col("lang"), F.lit(f"\nTarget languages: {', '.join(languages)}\n\nText:\n"), F.col("text"))
    return joined.select("doc_id", F.concat(body, F.coalesce(
        F.concat(F.lit("\n\nAcronyms found several times; extract one only if translators need guidance on it:\n"),
                 F.col("hint")), F.lit(""))).alias("request"))


def gap_terms(terms: DataFrame, languages: Column) -> DataFrame:
    """Terms that still miss a requested language."""
    return (terms.where("strategy <> 'skip'").withColumn("missing", M.missing_languages(F.col("targets"), languages))
            .where(F.size("missing") > 0))


def fill_gaps(terms: DataFrame, replies: DataFrame, languages: Column) -> DataFrame:
    """Fill empty languages from gap replies (doc_id, source, lang, target); clear the flag of
    terms that became complete. A later entry for the same source replaces an earlier one."""
    maps = replies.groupBy("doc_id", "source").agg(F.map_from_entries(
        F.collect_set(F.struct("lang", "target"))).alias("_new"))
    out = terms.join(maps, ["doc_id", "source"], "left")
    out = out.withColumn("targets", M.fill_empty(F.col("targets"), F.col("_new"))).drop("_new")
    complete = F.size(M.missing_languages(F.col("targets"), languages)) == 0
    return (out.withColumn("uncertainty_note", F.when(F.col("uncertain") & complete, "").otherwise(F.col("uncertainty_note")))
            .withColumn("uncertain", F.col("uncertain") & ~complete))

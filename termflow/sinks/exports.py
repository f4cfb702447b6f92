"""Writing terms and translated documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import maps as M
from ..functions import text as T

BOOKKEEPING = ["id", "domain_id", "norm", "created_at", "updated_at", "last_used_at", "use_count"]


def term_languages(terms: DataFrame) -> list[str]:
    """Languages of a library, the columns of its export. The list is as short as the number of
    languages, whatever the number of terms."""
    rows = terms.select(F.explode(F.map_keys("targets")).alias("lang")).distinct().orderBy("lang").collect()
    found = [r[0] for r in rows]
    return found if "en" in found else ["en", *found]


def delimited_terms(terms: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """A column per language, then the metadata. `en` falls back to the source."""
    value = lambda l: F.coalesce(F.element_at(M.or_empty(F.col("targets")), l), F.lit(""))
    cell = lambda l: F.when(value(l) == "", F.col("source")).otherwise(value(l)) if l == "en" else value(l)
    return terms.orderBy("norm").select(*[cell(l).alias(l) for l in languages or term_languages(terms)],
                                        "strategy", "ai_category", "context")


def json_terms(terms: DataFrame) -> DataFrame:
    """Terms without bookkeeping columns; the source stands under `en` when nothing else does."""
    out = terms.withColumn("targets", M.prefer_right(F.create_map(F.lit("en"), F.col("source")), F.col("targets")))
    return out.select("source", "targets", "strategy", "ai_category", "context")


def write_delimited(terms: DataFrame, path: str, sep: str = ",") -> None:
    delimited_terms(terms).write.csv(path, header=True, sep=sep, quote='"', escape='"', emptyValue="")


def write_json(terms: DataFrame, path: str) -> None:
    json_terms(terms).write.json(path)


def flat_json(blocks: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """One JSON object of key path -> text per file. Its entries are those of one file."""
    entries = F.array_sort(F.collect_list(F.struct("key_path", text.alias("text"))))
    return blocks.groupBy(*keys).agg(F.to_json(F.map_from_entries(entries)).alias("content"))


def drafts(blocks: DataFrame) -> DataFrame:
    """Final and draft text of every block: the draft ignores the review."""
    s, t, r = F.col("source_text"), F.col("translated_text"), F.col("reviewed_text")
    return blocks.withColumn("best_text", T.best_text(r, t, s)).withColumn("draft_text", T.best_text(F.lit(""), t, s))


def write_named(files: DataFrame, path: str) -> None:
    """One file for each row (name, content); a name may hold folders. Tasks write side by side; a repeated task writes the same."""
    def write(rows):
        from pyarrow import fs
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder)
        made = {folder}
        for r in rows:
            name = f"{folder}/{r.name}"
            if (parent := name.rpartition("/")[0]) not in made:
                store.create_dir(parent)
                made.add(parent)
            with store.open_output_stream(name) as out:
                out.write(r.content.encode())

    files.select("name", "content").foreachPartition(write)


def write_documents(docs: DataFrame, path: str) -> None:
    """Rebuilt documents (name, target_lang, text), one folder per language."""
    docs.write.partitionBy("target_lang").parquet(path)

"""Derived tables: a term library, extracted terms, jobs, runs and progress, built from the
given tables by Spark, and the same definitions as SQL fragments for cross-checks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..skew import global_rank
from .registry import table

TARGET_LANGS = ["fr", "de", "es"]
LIBRARY_COUNT = 50
#: A word is a term of its document if it stands there so many times, whatever the length of the document.
TERM_COUNT = 2
_LIBRARY: dict[tuple[str, str], DataFrame] = {}


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its lines; ordered work on a document stays in its row."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", "text", F.split("text", "\n").alias("lines"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", "lang", F.posexplode_outer("lines").alias("block_no", "source_text"))


#: Different words and pairs that a task counts before it passes them on.
HELD_GRAMS = 300_000
GRAMS = [(1, re.compile("[a-z]{3,}")), (2, re.compile("[a-z]{3,} [a-z]{3,}"))]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words (1) and pairs of words (2) of texts, for Spark to add up."""
    held: dict[tuple, Counter] = {}

    def passed():
        for (lang, cls), n in held.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(n), pa.string()), pa.array([cls] * len(n), pa.int32()), pa.array(list(n), pa.string()),
                pa.array(list(n.values()), pa.int64())], ["lang", "cls", "tok", "n"])
        held.clear()
    for batch in batches:
        for at in range(0, len(batch), 256):
            for lang, text in zip(*(batch.column(i).slice(at, 256).to_pylist() for i in (0, 1)), strict=True):
                for cls, pattern in GRAMS if text else ():
                    held.setdefault((lang, cls), Counter()).update(pattern.findall(text))
            if sum(map(len, held.values())) > HELD_GRAMS:
                yield from passed()
    yield from passed()


def _library(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("lang").cast("string"), F.lower("text").alias("t"))
    counts = (d.mapInArrow(_gram_counts, "lang string, cls int, tok string, n bigint")
              .groupBy("lang", "cls", "tok").agg(F.sum("n").alias("n")).where(F.col("n") >= LIBRARY_COUNT))
    order = [F.col("lang").asc_nulls_first(), F.col("cls"), F.desc("n"), F.col("tok")]
    placed = global_rank(counts, order, "place")
    first = placed.groupBy("lang", "cls").agg(F.min("place").alias("first"))  # one row per language and class
    ranked = (placed.alias("p").join(F.broadcast(first).alias("f"), F.col("p.lang").eqNullSafe(F.col("f.lang")) & (F.col("p.cls") == F.col("f.cls")))
              .select("p.lang", "p.cls", "tok", (F.col("place") - F.col("first") + 1).alias("r")))
    by = lambda l: F.max(F.when(F.col("lang") == l, F.col("tok")))
    wide = ranked.groupBy("cls", "r").agg(*[by(l).alias(l) for l in ["en", *TARGET_LANGS]]).where("en is not null")
    r = F.col("r")
    out = wide.select(
        (2 * r - F.when(F.col("cls") == 1, 1).otherwise(0)).cast("bigint").alias("id"),
        (r % 5).cast("bigint").alias("domain_id"), F.col("en").alias("source"),
        T.normalize_term(F.col("en")).alias("norm"), F.col("fr").alias("t_fr"),
        F.when(r % 7 == 0, "").otherwise(F.col("de")).alias("t_de"),
        F.when(r % 4 != 0, F.col("es")).alias("t_es"),
        F.when(r % 10 == 0, "skip").when(r % 10 == 1, "keep_original").otherwise("hard").alias("strategy"),
        F.when(r % 3 == 0, "domain_term").otherwise("").alias("ai_category"),
        F.when(r % 2 == 0, F.concat(F.lit("sense "), (r % 3).cast("string"))).otherwise("").alias("context"))
    return out


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored term library, written once per session: all words and pairs of words that stand at
    least LIBRARY_COUNT times in the texts of a language, matched over languages by their place."""
    from ..session import written
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LIBRARY:
        _LIBRARY[key] = written(_library(spark, sf_dir), "library")
    return _LIBRARY[key].withColumn("targets", language_map("t_fr", "t_de", "t_es"))


def language_map(*cols):
    pairs = [x for c in cols for x in (F.lit(c.split("_")[-1]), F.col(c))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def library_long(spark, sf_dir):
    return library(spark, sf_dir).select("id", "domain_id", "source", F.explode("targets").alias("lang", "target"))


def doc_terms(spark: SparkSession, sf_dir: str, least: int = TERM_COUNT) -> DataFrame:
    """Extracted terms: the words that stand at least `least` times in a document, most frequent first.

    Texts are dealt out by document once; their words are counted in the row, so nothing more is moved."""
    texts = (table(spark, sf_dir, "documents").select("doc_id", "lang", F.lower("text").alias("_text")).repartition("doc_id")
             .groupBy("doc_id", "lang").agg(F.collect_list("_text").alias("_texts")))
    terms = texts.select("doc_id", "lang", F.posexplode_outer(T.words_by_count("_texts", least)).alias("_at", "_w")).where("_w is not null")
    top = terms.select("doc_id", "lang", "_w.source", "_w.frequency", (F.col("_at") + 1).cast("bigint").alias("pos"))
    p = F.col("pos")
    return top.select(
        "doc_id", "lang", "pos", "source", "frequency",
        F.when(p % 4 != 0, F.concat("source", F.lit("_fr"))).alias("t_fr"),
        F.when(p % 2 == 0, F.concat("source", F.lit("_de"))).otherwise("").alias("t_de"),
        F.lit(None).cast("string").alias("t_es"),
        F.when(p % 5 == 0, "skip").when(p % 5 == 1, "keep_original").otherwise("hard").alias("strategy"),
        (p % 3 == 0).alias("confirmed")).withColumn("targets", language_map("t_fr", "t_de", "t_es"))


def doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of a document as a term of its glossary, also those that stand there once."""
    return doc_terms(spark, sf_dir, least=1)


EXTENSIONS = [".docx", ".pptx", ".srt", ".json", ".md"]


def job_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per line item: segments, status and language from its columns."""
    flag = F.concat("l_linestatus", "l_returnflag")
    langs = F.array(*[F.lit(x) for x in ["de", "es", "fr", "ja", "ko", "ru", "zh-CN"]])
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), "l_linenumber", "l_partkey", "l_suppkey",
        F.element_at(langs, F.col("l_linenumber") % 7 + 1).alias("target_lang"),
        F.col("l_quantity").cast("bigint").alias("segments_total"),
        F.floor(F.col("l_quantity") * (100 - F.round(F.col("l_discount") * 100)) / 100).cast("bigint").alias("segments_done"),
        F.when(flag == "FA", "done").when(flag == "FR", "error").when(flag == "FN", "cancelled")
        .when(flag == "OA", "translating").when(flag == "OR", "reviewing").otherwise("rebuilding").alias("status"),
        "l_shipdate")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.array(*[F.lit(x) for x in EXTENSIONS])
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("job_id"), F.concat(k.cast("string"), F.element_at(ext, (k % 5 + 1).cast("int"))).alias("filename"),
        F.when(F.col("o_orderstatus") == "F", F.when(k % 3 == 0, "error").otherwise("done"))
        .when(F.col("o_orderstatus") == "P", "translating").otherwise(
            F.when(k % 4 == 0, "cancelled").when(k % 4 == 1, "awaiting_glossary_review")
            .when(k % 4 == 2, "queued").otherwise("reviewing")).alias("status"),
        F.when(k % 10 != 0, F.col("o_orderdate")).alias("created_at"),
        F.when(k % 20 != 0, F.col("o_orderdate") + F.expr("interval 1 hour")).alias("started_at"),
        F.when(k % 40 != 0, F.col("o_orderdate") + F.expr("interval 2 hour")).alias("completed_at"),
        (k % 2 == 0).alias("use_glossary"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_progress(table(spark, sf_dir, "events"))


def shape_progress(events: DataFrame) -> DataFrame:
    e = F.col("event_type")
    return events.select(
        "event_id", "ts", F.col("user_id").alias("run_id"), (F.col("user_id") % 25).alias("job_id"),
        F.when(e == "signup", "queued").when(e == "view", "parsing").when(e == "click", "translating")
        .when(e == "purchase", "done").otherwise("error").alias("status"),
        F.floor("value").cast("bigint").alias("segments_done"))


def lines_with(fn):
    """Rebuild a document text from its lines: fn(line, 0-based position) -> text."""
    return F.array_join(F.transform("lines", fn), "\n")


# --- the same tables in SQL ------------------------------------------------------------------

SQL = {
    "blocks": """select doc_id, lang, cast(pos-1 as bigint) block_no, t source_text from (
        select doc_id, lang, unnest(string_split(text, chr(10))) t,
               generate_subscripts(string_split(text, chr(10)), 1) pos from documents)""",
    "lib_tok": """select lang, 1 cls, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) tok from documents
        union all select lang, 2, unnest(regexp_extract_all(lower(text), '[a-z]{3,} [a-z]{3,}')) from documents""",
    "lib_rank": f"""select *, row_number() over (partition by lang, cls order by n desc, tok) r
        from (select lang, cls, tok, count(*) n from lib_tok group by all) where n >= {LIBRARY_COUNT}""",
    "lib_wide": """select cls, cast(r as bigint) r, max(case when lang='en' then tok end) en, max(case when lang='fr' then tok end) fr,
        max(case when lang='de' then tok end) de, max(case when lang='es' then tok end) es
        from lib_rank group by cls, r""",
    "library": """select 2*r - case when cls=1 then 1 else 0 end id, r%5 domain_id, en source, lower(trim(en)) norm,
        fr t_fr, case when r%7=0 then '' else de end t_de, case when r%4<>0 then es end t_es,
        case when r%10=0 then 'skip' when r%10=1 then 'keep_original' else 'hard' end strategy,
        case when r%3=0 then 'domain_term' else '' end ai_category,
        case when r%2=0 then 'sense ' || (r%3) else '' end context
        from lib_wide where en is not null""",
    "library_long": """select id, domain_id, source, 'fr' lang, t_fr target from library where t_fr is not null
        union all select id, domain_id, source, 'de', t_de from library where t_de is not null
        union all select id, domain_id, source, 'es', t_es from library where t_es is not null""",
    "doc_terms": f"""select doc_id, lang, pos, source, frequency,
        case when pos%4<>0 then source || '_fr' end t_fr, case when pos%2=0 then source || '_de' else '' end t_de,
        cast(null as varchar) t_es,
        case when pos%5=0 then 'skip' when pos%5=1 then 'keep_original' else 'hard' end strategy, pos%3=0 confirmed
        from (select *, row_number() over (partition by doc_id order by frequency desc, source) pos from (
              select doc_id, lang, source, count(*) frequency from (
                  select doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) source from documents)
              group by all) where frequency >= {TERM_COUNT})""",
    "job_runs": """select l_orderkey job_id, l_linenumber, l_partkey, l_suppkey,
        (['de','es','fr','ja','ko','ru','zh-CN'])[l_linenumber % 7 + 1] target_lang,
        cast(l_quantity as bigint) segments_total,
        cast(floor(l_quantity * (100 - round(l_discount*100)) / 100) as bigint) segments_done,
        case l_linestatus || l_returnflag when 'FA' then 'done' when 'FR' then 'error' when 'FN' then 'cancelled'
            when 'OA' then 'translating' when 'OR' then 'reviewing' else 'rebuilding' end status, l_shipdate
        from lineitem""",
    "jobs": """select o_orderkey job_id, o_orderkey || (['.docx','.pptx','.srt','.json','.md'])[cast(o_orderkey % 5 + 1 as int)] filename,
        case o_orderstatus when 'F' then case when o_orderkey%3=0 then 'error' else 'done' end
            when 'P' then 'translating' else case o_orderkey%4 when 0 then 'cancelled' when 1 then 'awaiting_glossary_review'
            when 2 then 'queued' else 'reviewing' end end status,
        case when o_orderkey%10<>0 then o_orderdate end created_at,
        case when o_orderkey%20<>0 then o_orderdate + interval 1 hour end started_at,
        case when o_orderkey%40<>0 then o_orderdate + interval 2 hour end completed_at,
        o_orderkey%2=0 use_glossary from orders""",
    "progress": """select event_id, ts, user_id run_id, user_id%25 job_id,
        case event_type when 'signup' then 'queued' when 'view' then 'parsing' when 'click' then 'translating'
            when 'purchase' then 'done' else 'error' end status, cast(floor(value) as bigint) segments_done from events""",
    # Brute-force occurrences: every term against every line.
    "lib_hits": """select b.doc_id, b.block_no, b.source_text, l.id, l.source, l.norm,
        (length(b.source_text) - length(replace(lower(b.source_text), l.norm, ''))) // length(l.norm) n
        from blocks b join library l on contains(lower(b.source_text), l.norm)""",
}

SQL["doc_words"] = SQL["doc_terms"].replace(f" where frequency >= {TERM_COUNT}", "")

DEPENDS = {
    "lib_rank": ["lib_tok"], "lib_wide": ["lib_rank"], "library": ["lib_wide"], "library_long": ["library"],
    "lib_hits": ["blocks", "library"],
}


def sql(body: str, *views: str, **extra: str) -> str:
    """A query with the derived tables it names as common table expressions."""
    order: list[str] = []

    def need(v):
        for d in DEPENDS.get(v, []):
            need(d)
        if v not in order:
            order.append(v)

    for v in views:
        need(v)
    parts = [f"{v} as ({SQL[v]})" for v in order] + [
        f"{k} as ({v})" for k, v in extra.items()]
    return (f"with recursive {', '.join(parts)} " if parts else "") + body

"""Quality checks and regression tracking."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import checks as C
from ..operators import quality as Q
from .registry import ints, query, table
from .views import blocks, docs, library, sql

RESULTS = """select source run_id, quality * 100.0 - toxic * 50.0 overall from labels join documents using (doc_id)"""


def results(spark, d):
    r = table(spark, d, "labels").join(docs(spark, d).select("doc_id", F.col("source").alias("run_id")), "doc_id")
    return r.select("run_id", (F.col("quality") * 100.0 - F.col("toxic") * 50.0).alias("overall"))


@query("run_averages", "A9", sql("select run_id, round(avg(overall::double), 6) average_overall, count(*) n_results from res group by run_id", res=RESULTS))
def run_averages(spark, d):
    r = Q.run_averages(results(spark, d))
    return r.select("run_id", F.round("average_overall", 6).alias("average_overall"), "n_results")


AVG = "select run_id, avg(overall::double) a from res group by run_id"


@query("latest_comparison", "W14 Q6", sql("""
    select c.run_id current_run, p.run_id previous_run, round(c.a - p.a, 6) delta, c.a - p.a > 0 improved, c.a - p.a < -2.0 regressed
    from (select * from av order by run_id desc limit 1) c, (select * from av order by run_id desc limit 1 offset 1) p""", res=RESULTS, av=AVG))
def latest_comparison(spark, d):
    c = Q.compare_latest(Q.run_averages(results(spark, d)), ["run_id"])
    return c.select("current_run", "previous_run", F.round("delta", 6).alias("delta"), "improved", "regressed")


@query("latest_runs", "T6", sql("select run_id, round(a, 6) average_overall from av order by run_id desc limit 10", res=RESULTS, av=AVG))
def latest_runs(spark, d):
    return Q.run_averages(results(spark, d)).orderBy(F.desc("run_id")).limit(10).select("run_id", F.round("average_overall", 6).alias("average_overall"))


# Translations that follow the library in two of three lines.
TRANSLATED = "case block_no % 3 when 0 then source_text when 1 then '' else concat('[T]', regexp_replace(lower(source_text), '[a-z]+', 'x')) end"


def translated(spark, d):
    b = blocks(spark, d)
    x = F.when(F.col("block_no") % 3 == 0, F.col("source_text")).when(F.col("block_no") % 3 == 1, "").otherwise(
        F.concat(F.lit("[T] "), F.lower("source_text"), F.lit(" "), F.col("lang")))
    return b.withColumn("translated_text", x)


TR = """select doc_id, lang, block_no, source_text, case block_no%3 when 0 then source_text when 1 then '' else '[T] ' || lower(source_text) || ' ' || lang end tx from blocks"""


@query("empty_translations", "Q2", sql("select lang, count(*) n from tr where trim(tx) = '' group by lang", "blocks", tr=TR))
def empty_translations(spark, d):
    return C.empty_translations(translated(spark, d)).groupBy("lang").agg(F.count("*").alias("n"))


ADH = """select t.doc_id, t.block_no, l.id, t.lang, contains(lower(tx), e) ok from lib_hits h
    join tr t on t.doc_id = h.doc_id and t.block_no = h.block_no
    join (select *, case when strategy = 'keep_original' then norm else lower(t_fr) end e from library) l on l.id = h.id where coalesce(e, '') <> ''"""


def expectations(spark, d):
    return library(spark, d).select("id", F.col("norm").alias("source"), F.when(F.col("strategy") == "keep_original", F.col("norm")).otherwise(
        F.coalesce("t_fr", F.lit(""))).alias("expected"))


@query("glossary_violations", "J15", sql("select doc_id, block_no, id from adh where not ok", "lib_hits", tr=TR, adh=ADH))
def glossary_violations(spark, d):
    v = C.adherence(translated(spark, d), expectations(spark, d)).where("not kept")
    return ints(v.select("doc_id", "block_no", "id"))


@query("glossary_adherence", "Q3", sql("""
    select lang, count(*) n_expected, count(*) filter (ok) n_kept, round(count(*) filter (ok) / count(*)::double, 6) rate from adh group by lang""", "lib_hits", tr=TR, adh=ADH))
def glossary_adherence(spark, d):
    a = C.adherence_rates(C.adherence(translated(spark, d), expectations(spark, d)), ["lang"])
    return a.withColumn("rate", F.round("rate", 6))


@query("rebuild_categories", "Q4", sql("""
    select category, count(*) n from (select case when (doc_id + block_no) % 11 = 0 then 'lost' when trim(source_text) = '' then 'blank_kept' when (doc_id+block_no)%4=0 then 'unchanged'
      when (doc_id+block_no)%4=1 then 'translated' when (doc_id+block_no)%4=2 then 'translated_loosely' else 'unmarked' end category from blocks) group by all
    union all select 'invented', count(*) from documents""", "blocks"))
def rebuild_categories(spark, d):
    b = blocks(spark, d)
    k = (F.col("doc_id") + F.col("block_no")) % 4
    s = T.strip(F.col("source_text"))
    out = b.where("(doc_id + block_no) % 11 <> 0").withColumn("output_text", F.when(s == "", F.col("source_text")).when(k == 0, F.col("source_text"))
        .when(k == 1, F.concat(F.lit(">[T]"), s)).when(k == 2, F.concat(F.lit("[T]!"), s)).otherwise(F.concat(F.lit("!"), s)))
    extra = docs(spark, d).select("doc_id", F.lit(-1).alias("block_no"), F.lit("[T]more").alias("output_text"))
    return Q.rebuild_categories(b, out.select("doc_id", "block_no", "output_text").unionByName(extra), ["doc_id", "block_no"])


@query("intake_checks", "SRC2 SRC1 Q1", """
    select verdict, reader, count(*) n from (
      select case when ext not in ('.docx','.srt','.md','.xlf') then 'unsupported' when p_retailprice * 50000 > 52428800 then 'too_large' else 'ok' end verdict,
        case ext when '.docx' then 'docx' when '.srt' then 'srt' when '.md' then 'md' when '.xlf' then 'xliff' else '' end reader
      from (select *, (['.docx','.srt','.md','.xlf','.exe'])[cast(p_partkey % 5 + 1 as int)] ext from part)) group by all""")
def intake_checks(spark, d):
    from ..sources.files import check_files
    ext = F.element_at(F.array(*[F.lit(x) for x in (".docx", ".SRT", ".md", ".xlf", ".exe")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    f = table(spark, d, "part").select(F.concat(F.lit("/in/"), F.translate("p_name", ". ", "__"), ext).alias("path"), (F.col("p_retailprice") * 50000).alias("length"))
    return check_files(f).groupBy("verdict", "reader").agg(F.count("*").alias("n"))

"""Glossaries of documents."""

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import glossary as G
from ..operators import library as L
from .registry import ints, query, table
from .term_queries import langs
from .views import doc_terms, doc_words, library, sql
from .library_queries import INDEX

LIB_TERMS = """select t.*, i.id library_id, case when i.id is null then '' when t.t_de = '' then 'MISSING' else '' end note from doc_words t left join idx i on i.key = t.source"""
LIB = dict(idx=INDEX, lt=LIB_TERMS)


def terms(t):
    t = t.withColumn("context", F.when(F.col("pos") % 3 == 1, "topic").otherwise("")).withColumn(
        "category", F.when(F.col("pos") % 2 == 0, "a|b").otherwise("c")).withColumn("do_not_translate", F.col("pos") == 7)
    return t


def lib_terms(spark, d):
    m = L.match_any_value(doc_words(spark, d), library(spark, d))
    missing = F.col("lib").isNotNull() & (F.col("t_de") == "")
    return m.withColumn("library_id", F.col("lib.id")).withColumn("uncertainty_note", F.when(missing, "MISSING").otherwise("")).withColumn(
        "ai_category", F.when(F.col("pos") % 2 == 0, "brand").otherwise("")).drop("lib", "key")


CTX = "case when pos%3=1 then ' (topic)' else '' end"
TGT = "case when pos=7 then source else coalesce(t_fr, '') end"
LINES = f"""select *, case when confirmed and (strategy = 'keep_original' or (strategy = 'hard' and pos = 7)) then 'keep unchanged, do not translate'
      when confirmed and strategy = 'hard' and {TGT} <> '' then 'must use "' || {TGT} || '"'
        || case when pos=3 then ' and on the first occurrence in this segment use "' || {TGT} || ' (' || source || ')"' else '' end
      when not confirmed and strategy = 'hard' and {TGT} <> '' and {TGT} <> source then 'prefer "' || {TGT} || '"' end rule from doc_words"""


@query("constraint_texts", "F16 F-TGT", sql(f"""
    select doc_id, md5(concat_ws(chr(10) || chr(10),
      '{(K.HARD_HEADER + K.FIRST_USE_HEADER).strip().replace(chr(10), "' || chr(10) || '")}' || chr(10) || string_agg(l, chr(10) order by pos) filter (confirmed),
      '{K.SOFT_HEADER.strip()}' || chr(10) || string_agg(l, chr(10) order by pos) filter (not confirmed))) constraints
    from (select doc_id, pos, confirmed, '- "' || source || '" -> ' || rule || {CTX} l from lines where rule is not null) group by doc_id""",
    "doc_words", lines=LINES))
def constraint_texts(spark, d):
    lines = G.constraint_lines(terms(doc_words(spark, d)), F.lit("fr"), F.col("pos") == 3)
    return G.constraint_text(lines, ["doc_id"], bilingual=True).select("doc_id", F.md5("constraints").alias("constraints"))


@query("resolved_targets", "F-TGT", """
    select p_partkey, case when p_size%5=0 then p_name when p_size%5=1 then '' when p_size%5=2 then p_brand when p_size%5=3 then p_type else '' end fr
    from part""")
def resolved_targets(spark, d):
    from ..functions import maps as M
    s = F.col("p_size") % 5
    m = (F.when(s == 1, F.create_map(F.lit("fr"), F.lit(""), F.lit("FR"), F.col("p_brand")))
         .when(s == 2, F.create_map(F.lit("fr-CA"), F.col("p_type"), F.lit("FR"), F.col("p_brand")))
         .when(s == 3, F.create_map(F.lit("de"), F.col("p_brand"), F.lit("FR-ca"), F.col("p_type")))
         .otherwise(F.create_map(F.lit("de"), F.col("p_brand"))))
    return table(spark, d, "part").select("p_partkey", M.resolve_target(m, F.lit("fr"), F.col("p_name"), s == 0).alias("fr"))


@query("glossary_summary", "A4", sql("""
    select doc_id, count(library_id) library_terms, count(*) - count(library_id) new_terms, count(*) filter (note <> '') uncertain,
      count(*) filter (strategy <> 'skip') constraints, max(frequency) max_frequency from lt group by doc_id""", "doc_words", "library_long", **LIB))
def glossary_summary(spark, d):
    return G.summary(lib_terms(spark, d), ["doc_id"])


@query("glossary_languages", "A12", sql("""
    select doc_id, case when bool_or(pos=1) then 'fr,de' else 'de' end languages from doc_terms group by doc_id""", "doc_terms"))
def glossary_languages(spark, d):
    return G.languages_in_order(doc_terms(spark, d))


@query("confirmed_terms", "P11", sql("""
    select doc_id, pos, confirmed or strategy <> 'skip' all_confirmed, confirmed or pos in (5, 10) by_list from doc_terms""", "doc_terms"))
def confirmed_terms(spark, d):
    t = doc_terms(spark, d)
    a = G.confirm(t).select("doc_id", "pos", F.col("confirmed").alias("all_confirmed"))
    b = G.confirm(t, t.where("pos in (5, 10)")).select("doc_id", "pos", F.col("confirmed").alias("by_list"))
    return a.join(b, ["doc_id", "pos"])


@query("edited_glossary", "U9", sql("""
    select doc_id, pos, case when pos=2 then 'skip' else strategy end strategy, case when pos in (2,4) then '' else t_fr end fr, t_de de,
      pos = 4 save from doc_words where pos <> 6""", "doc_words"))
def edited_glossary(spark, d):
    t = doc_words(spark, d).withColumn("save", F.lit(False))
    places = table(spark, d, "documents").select("doc_id").distinct().withColumn("pos", F.explode(F.array(*[F.lit(p).cast("bigint") for p in (2, 4, 6)])))
    e = places.select(
        "doc_id", "pos", F.when(F.col("pos") == 6, "remove").otherwise("set").alias("action"),
        F.when(F.col("pos") == 2, "skip").alias("strategy"), F.create_map(F.lit("fr"), F.lit("")).alias("targets"),
        F.when(F.col("pos") == 4, F.lit(True)).alias("save"))
    m = F.col("targets")
    return G.apply_edits(t, e).select("doc_id", "pos", "strategy", m["fr"].alias("fr"), m["de"].alias("de"), "save")


@query("appended_terms", "W13", sql("""
    select doc_id, printf('term_%03d', 3*pos) term_id, source from doc_terms union all
    select doc_id, printf('term_%03d', 3*m + s), 'added' || s from (select doc_id, max(pos) m from doc_terms group by 1), (values (1), (2)) v(s)""", "doc_terms"))
def appended_terms(spark, d):
    t = doc_terms(spark, d).select("doc_id", F.format_string("term_%03d", F.col("pos") * 3).alias("term_id"), "source")
    new = t.select("doc_id").distinct().select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq")).withColumn(
        "source", F.concat(F.lit("added"), "seq"))
    return G.append_terms(t, new)


@query("modified_library_terms", "J13", sql("select doc_id, pos, library_id from lt where pos % 4 = 1 and library_id is not null and coalesce(t_fr,'') <> 'x'",
       "doc_words", "library_long", **LIB))
def modified_library_terms(spark, d):
    from ..functions import maps as M
    t = lib_terms(spark, d)
    edit = t.withColumn("targets", F.when(F.col("pos") % 4 == 1, M.prefer_right(F.col("targets"), F.create_map(F.lit("fr"), F.lit("x")))).otherwise(F.col("targets")))
    return G.modified(edit, t).select("doc_id", "pos", "library_id")


@query("glossary_review_list", "P13 T1", sql("""
    select doc_id, pos, source, frequency, row_number() over (partition by doc_id order by frequency desc, pos) rank
    from lt where note <> '' and library_id is not null and pos % 2 = 1""", "doc_words", "library_long", **LIB))
def glossary_review_list(spark, d):
    from pyspark.sql import Window
    r = G.review_filter(lib_terms(spark, d).withColumn("ai_category", F.when(F.col("pos") % 2 == 1, "brand").otherwise("")), True, "brand", "library")
    return ints(r.select("doc_id", "pos", "source", "frequency", F.row_number().over(
        Window.partitionBy("doc_id").orderBy(F.desc("frequency"), "pos")).alias("rank")))


@query("glossary_table", "SNK3", sql(f"""
    select doc_id, pos, source, {TGT} fr, case when pos=7 then source else t_de end de, case when pos=7 then source else '' end ja,
      case when pos%2=0 then 'a|b' else 'c' end category, case when pos%3=1 then 'topic' else '' end context, frequency, pos=7 do_not_translate from doc_terms""", "doc_terms"))
def glossary_table(spark, d):
    return G.table_rows(terms(doc_terms(spark, d)), ["fr", "de", "ja"])


ROW = lambda sep, esc: f"concat_ws('{sep}', source, {TGT}, case when pos=7 then source else t_de end, case when pos%2=0 then 'a{esc}|b' else 'c' end, case when pos%3=1 then 'topic' else '' end, frequency, case when pos=7 then 'True' else 'False' end)"


@query("glossary_texts", "SNK4", sql(f"""
    select doc_id, md5('| source | fr | de | category | context | frequency | do_not_translate |' || chr(10) || '| --- | --- | --- | --- | --- | --- | --- |' || chr(10)
        || string_agg('| ' || {ROW(' | ', chr(92))} || ' |', chr(10) order by pos)) markdown,
      md5(replace('source,fr,de,category,context,frequency,do_not_translate', ',', chr(9)) || chr(10) || string_agg(replace({ROW('@@', '')}, '@@', chr(9)), chr(10) order by pos)) tsv
    from doc_words group by doc_id""", "doc_words"))
def glossary_texts(spark, d):
    rows = G.table_rows(terms(doc_words(spark, d)), ["fr", "de"])
    cols = ["source", "fr", "de", "category", "context", "frequency", "do_not_translate"]
    md = G.as_text(rows, cols, True).select("doc_id", F.md5("content").alias("markdown"))
    return md.join(G.as_text(rows, cols, False).select("doc_id", F.md5("content").alias("tsv")), "doc_id")

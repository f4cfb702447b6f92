"""Term library operators."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import library as L
from ..operators import library_store as LS
from .registry import ints, query, table
from .term_queries import langs
from .views import doc_terms, docs, library, library_long, language_map, sql

M3 = lambda: [F.col("targets")[l].alias(l) for l in ("fr", "de", "es")]

INDEX = """select key, id, domain_id, strategy, t_fr, t_de, t_es from (
    select *, row_number() over (partition by key order by prio, domain_id, id) r from (
      select norm key, 0 prio, l.* from library l
      union all select lower(trim(x.target)), 1, l.* from library l join library_long x using (id) where x.target <> '')) where r = 1"""


@query("exact_term_matches", "J1", sql("""
    select t.doc_id, t.pos, t.source, l.id library_id, l.domain_id from doc_terms t
    join (select *, row_number() over (partition by norm order by domain_id, id) r from library) l on l.norm = t.source and l.r = 1
    """, "doc_terms", "library"))
def exact_term_matches(spark, d):
    t = doc_terms(spark, d).select("doc_id", "pos", "source")
    return L.exact_matches(t, library(spark, d))


@query("bidirectional_matches", "J2", sql("""
    select t.doc_id, t.pos, t.source, i.id library_id from doc_terms t join idx i on i.key = t.source""",
    "doc_terms", "library_long", idx=INDEX))
def bidirectional_matches(spark, d):
    t = doc_terms(spark, d).select("doc_id", "pos", "source")
    return L.match_any_value(t, library(spark, d), "inner").select("doc_id", "pos", "source", F.col("lib.id").alias("library_id"))


@query("domain_value_matches", "J3", sql("""
    select t.doc_id, t.pos, i.domain_id, min(i.id) filter (r = 1) library_id from doc_terms t join (
      select *, row_number() over (partition by key, domain_id order by prio, id) r from (
        select norm key, 0 prio, domain_id, id from library union all
        select lower(trim(x.target)), 1, l.domain_id, l.id from library l join library_long x using (id) where x.target <> '')) i
      on i.key = t.source and r = 1 group by all""", "doc_terms", "library_long"))
def domain_value_matches(spark, d):
    from ..skew import salted_join
    t = doc_terms(spark, d).select("doc_id", "pos", F.col("source").alias("key"))
    i = L.any_value_index(library(spark, d), per_domain=True)
    return salted_join(t, i, ["key"], ["doc_id"]).select("doc_id", "pos", "domain_id", F.col("lib.id").alias("library_id"))


PADDED = "select doc_id, ' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}_ ]', ' | ', 'g') || ' ' t, lower(text) lt from documents"
FOUND = """select doc_id, l.*, (length(lt) - length(replace(lt, norm, ''))) // length(norm) frequency from padded join library l on
    (contains(t, ' ' || norm || ' ') or (t_fr <> '' and contains(t, ' ' || t_fr || ' ')) or (t_de <> '' and contains(t, ' ' || t_de || ' '))
     or (t_es <> '' and contains(t, ' ' || t_es || ' ')))
    where not exists (select 1 from matched m where m.doc_id = padded.doc_id and m.norm = l.norm)"""
MATCHED = "select distinct t.doc_id, t.source norm from doc_terms t join idx i on i.key = t.source"
KEPT = """select * from found f where not exists (select 1 from (select doc_id, norm from found union all select doc_id, norm from matched) c
    where c.doc_id = f.doc_id and c.norm <> f.norm and contains(c.norm, f.norm))"""
SUPP = dict(idx=INDEX, matched=MATCHED, padded=PADDED, found=FOUND, kept=KEPT)
MISSING = lambda fr, de, es: f"concat_ws(',', case when coalesce({fr},'')='' then 'fr' end, case when coalesce({de},'')='' then 'de' end, case when coalesce({es},'')='' then 'es' end)"
NOTE = lambda m: f"case when {m} <> '' then 'MISSING_TRANSLATIONS:' || {m} else '' end"


@query("supplemented_terms", "J5 J7 F-FLAG", sql(f"""
    select doc_id, id, norm, cast(frequency as bigint) frequency, {NOTE(MISSING('t_fr', 't_de', 't_es'))} note from kept""",
    "doc_terms", "library_long", **SUPP))
def supplemented_terms(spark, d):
    lib = library(spark, d)
    m = L.match_any_value(doc_terms(spark, d), lib, "inner").select("doc_id", F.col("key").alias("norm")).distinct()
    s = L.supplement(docs(spark, d), lib, m, langs())
    return s.select("doc_id", "id", "norm", "frequency", F.col("uncertainty_note").alias("note"))


MERGED = f"""select t.doc_id, t.source, (length(lower(text)) - length(replace(lower(text), t.source, ''))) // length(t.source) frequency,
      coalesce(i.t_fr, t.t_fr) fr, coalesce(i.t_de, t.t_de) de, coalesce(i.t_es, t.t_es) es, i.strategy, true confirmed,
      (t.t_fr <> '' and i.t_fr <> '' and t.t_fr <> i.t_fr) or (t.t_de <> '' and i.t_de <> '' and t.t_de <> i.t_de) differs,
      i.id library_id, 0 part, pos r1, 0 r2, 0 r3 from doc_terms t join idx i on i.key = t.source join documents d on d.doc_id = t.doc_id
    union all select doc_id, source, frequency, t_fr, t_de, t_es, strategy,
      {MISSING('t_fr', 't_de', 't_es')} = '', null, id, 1, -length(source), domain_id, id from kept
    union all select doc_id, source, frequency, t_fr, t_de, t_es, strategy, confirmed, null, null, 2, pos, 0, 0 from doc_terms t
      where not exists (select 1 from idx i where i.key = t.source)"""


@query("merged_glossary", "J4 J5 J7 F-MAP3 F-FLAG W12", sql(f"""
    select doc_id, printf('term_%03d', row_number() over (partition by doc_id order by part, r1, r2, r3)) term_id,
      source, cast(frequency as bigint) frequency, fr, de, es, strategy, confirmed, library_id,
      case when part < 2 and {MISSING('fr','de','es')} <> '' then 'MISSING_TRANSLATIONS:' || {MISSING('fr','de','es')}
           when differs then 'TRANSLATION_DIFFERS' else '' end note from merged""",
    "doc_terms", "library_long", **SUPP, merged=MERGED))
def merged_glossary(spark, d):
    m = L.merge_extracted(doc_terms(spark, d).drop("lang", "t_fr", "t_de", "t_es"), docs(spark, d), library(spark, d), langs())
    return m.select("doc_id", "term_id", "source", "frequency", *M3(), "strategy", "confirmed", "library_id",
                    F.col("uncertainty_note").alias("note"))


def import_batch(spark, d):
    """Every extracted term as an import row: many documents bring the same term."""
    t = doc_terms(spark, d)
    return t.select((F.col("doc_id") * 1_000_000 + F.col("pos")).alias("row_no"), (F.col("doc_id") % 5).alias("domain_id"),
                    F.concat(F.lit(" "), "source").alias("source"), language_map("t_fr", "t_de").alias("targets"),
                    "strategy", F.lit("").alias("ai_category"), F.col("lang").alias("context"))


BATCH = "select doc_id*1000000+pos row_no, doc_id%5 domain_id, source, t_fr, t_de, strategy, lang context from doc_terms"
PRE = """select domain_id, source norm, arg_max(strategy, row_no) strategy, arg_max(context, row_no) context, count(*) n_rows, min(row_no) first_row,
    arg_max(t_fr, row_no) filter (t_fr <> '') fr, arg_max(t_de, row_no) filter (t_de <> '') de from batch group by all"""
UPS = """select coalesce(l.domain_id, p.domain_id) domain_id, coalesce(l.norm, p.norm) norm, l.id, coalesce(p.strategy, l.strategy) strategy,
    coalesce(p.context, l.context) context, coalesce(p.fr, l.t_fr) fr, coalesce(p.de, l.t_de) de, l.t_es es, l.id is not null existed,
    coalesce(n_rows, 0) n_rows, first_row from library l full join pre p on l.domain_id = p.domain_id and l.norm = p.norm"""
UPSERT = dict(batch=BATCH, pre=PRE, ups=UPS)


@query("upserted_library", "U2 F-MAP1", sql("""
    select case when existed then id else (select max(id) from library) + row_number() over (partition by existed order by first_row) end id,
      domain_id, norm, strategy, context, fr, de, es from ups""", "doc_terms", "library", **UPSERT))
def upserted_library(spark, d):
    u = L.upsert(library(spark, d), import_batch(spark, d))
    return u.select("id", "domain_id", "norm", "strategy", "context", *M3())


@query("stored_library", "U2 U3", sql("""
    select case when existed then id else (select max(id) from library) + row_number() over (partition by existed order by first_row) end id,
      domain_id, norm, strategy, context, fr, de, es from ups""", "doc_terms", "library", **UPSERT))
def stored_library(spark, d):
    """The library in buckets after an import that touches some of them."""
    first = library(spark, d)
    store = LS.StoredLibrary(spark, None, first.schema)
    store.load(first)
    store.upsert(import_batch(spark, d), "import-1")
    return store.read().select("id", "domain_id", "norm", "strategy", "context", *M3())


@query("import_summary", "A14", sql("""
    select cast(count(*) filter (not existed) as bigint) inserted,
      cast(sum(n_rows) - count(*) filter (not existed) as bigint) updated from ups where n_rows > 0""", "doc_terms", "library", **UPSERT))
def import_summary(spark, d):
    return L.import_summary(L.upsert(library(spark, d), import_batch(spark, d)))


def edits(spark, d):
    e = table(spark, d, "part").select((F.col("p_partkey") + 1).alias("id"), "p_size", "p_brand")
    return e.groupBy("id").agg(F.max("p_size").alias("s"), F.max("p_brand").alias("b")).select(
        "id", F.create_map(F.lit("fr"), F.when(F.col("s") % 2 == 0, "").otherwise(F.col("b")), F.lit("ja"),
                           F.when(F.col("s") % 3 == 0, "").otherwise(F.lit("語"))).alias("targets"),
        F.when(F.col("s") % 5 == 0, "skip").alias("strategy"))


@query("edited_library", "U4 F-MAP2", sql("""
    select l.id, case when e.id is null then t_fr when s%2=0 and t_fr is null then null when s%2=0 then '' else b end fr, t_de de,
      case when e.id is not null and s%3<>0 then '語' end ja, case when s%5=0 then 'skip' else strategy end strategy
    from library l left join (select p_partkey+1 id, max(p_size) s, max(p_brand) b from part group by all) e using (id)""", "library"))
def edited_library(spark, d):
    m = F.col("targets")
    return L.update_terms(library(spark, d), edits(spark, d)).select(
        "id", m["fr"].alias("fr"), m["de"].alias("de"), m["ja"].alias("ja"), "strategy")


@query("library_after_delete", "U5", sql("""
    select id, domain_id, norm from library where id not in (select p_partkey from part where p_size < 10)""", "library"))
def library_after_delete(spark, d):
    ids = table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("id"))
    return L.delete_terms(library(spark, d), ids).select("id", "domain_id", "norm")


def nations(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("domain_id"), F.col("n_name").alias("name"))


@query("library_after_domain_delete", "U5", sql("""
    select id, domain_id, norm from library where domain_id not in (select n_nationkey from nation where n_regionkey = 0)""", "library"))
def library_after_domain_delete(spark, d):
    gone = table(spark, d, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").cast("bigint").alias("domain_id"))
    return L.delete_domain(nations(spark, d), library(spark, d), gone)[1].select("id", "domain_id", "norm")


@query("touched_library", "U6", sql("""
    select id, 3 + (case when u.i is null then 0 else 1 end) use_count, case when u.i is not null then '2024-02-01' else '2023-01-01' end last_used
    from library left join (select distinct user_id i from events) u on u.i = id""", "library").replace("3 + (", "cast(3 + (").replace("end) use_count", "end) as bigint) use_count"))
def touched_library(spark, d):
    lib = library(spark, d).withColumn("use_count", F.lit(3).cast("bigint")).withColumn("last_used_at", F.lit("2023-01-01").cast("timestamp"))
    used = table(spark, d, "events").select(F.col("user_id").alias("id"))
    t = L.touch(lib, used, F.lit("2024-02-01").cast("timestamp"))
    return t.select("id", "use_count", F.date_format("last_used_at", "yyyy-MM-dd").alias("last_used"))


@query("ensured_domains", "U7", """
    select cast(n_nationkey as bigint) domain_id, n_name as name from nation union all
    select (select max(n_nationkey) from nation) + row_number() over (order by s), s from (select distinct c_mktsegment s from customer
      where c_mktsegment not in (select n_name from nation))""")
def ensured_domains(spark, d):
    names = table(spark, d, "customer").select(F.concat(F.col("c_mktsegment"), F.lit(" ")).alias("name"))
    return ints(L.ensure_domains(nations(spark, d), names))


def customer_domains(spark, d):
    """A domain per customer, so their number grows with the tables."""
    return table(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("domain_id"), F.col("c_name").alias("name"))


@query("renamed_domains", "U7", "select cast(c_custkey as bigint) domain_id, case when c_custkey = 3 then 'New name' else c_name end as name from customer")
def renamed_domains(spark, d):
    return ints(L.rename_domain(customer_domains(spark, d), 3, " New name ").select("domain_id", "name"))


@query("seeded_domains", "SRC18", "select c_name as name from customer union all select unnest(['%s'])" % "','".join(
    __import__("termflow.functions.constants", fromlist=["DOMAINS"]).DOMAINS))
def seeded_domains(spark, d):
    return L.default_domains(L.default_domains(customer_domains(spark, d))).select("name")


@query("domain_sizes", "J9 A3", sql("""
    select n_nationkey::bigint domain_id, n_name as name, count(id) term_count from nation left join library on domain_id = n_nationkey group by all""", "library"))
def domain_sizes(spark, d):
    return L.domain_sizes(nations(spark, d), library(spark, d))


@query("term_page", "T2 P10", sql("""
    select id, norm, (select count(*) from library where domain_id = 2 and norm like '%t_e%') total from library
    where domain_id = 2 and norm like '%t_e%' order by norm, id limit 10 offset 3""", "library"))
def term_page(spark, d):
    return LS.TermPages(library(spark, d)).page(2, " T_e", 3, 10).select("id", "norm", "total")


@query("deep_term_page", "T2", sql("""
    select id, norm, (select count(*) from library where domain_id = 3) total from library
    where domain_id = 3 order by norm, id limit 25 offset (select count(*) * 3 // 4 from library where domain_id = 3)""", "library"))
def deep_term_page(spark, d):
    pages = LS.TermPages(library(spark, d), 64)
    size = pages.directory.where("domain_id = 3").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return pages.page(3, "", size * 3 // 4, 25).select("id", "norm", "total")


@query("longest_terms_first", "T3 SRC14", sql("""
    select id, domain_id, source, row_number() over (order by length(source) desc, domain_id, id) rank from library where domain_id in (1, 3)""", "library"))
def longest_terms_first(spark, d):
    return ints(L.longest_first(library(spark, d), [1, 3]).select("id", "domain_id", "source", "rank"))


@query("visible_languages", "P17", sql("select distinct lang from library_long union select 'en'", "library_long"))
def visible_languages(spark, d):
    return L.visible_languages(library(spark, d))


@query("usable_constraints", "P9", sql("""
    select id, x.lang from library l, (values ('fr'), ('de'), ('es'), ('ja')) x(lang) where strategy <> 'skip' and (strategy <> 'hard'
      or coalesce(case x.lang when 'fr' then t_fr when 'de' then t_de when 'es' then t_es end, '') <> '')""", "library"))
def usable_constraints(spark, d):
    return L.usable_constraints(library(spark, d), ["fr", "de", "es", "ja"]).select("id", "lang")


def save_docs(spark, d):
    k = F.col("doc_id")
    return docs(spark, d).select("doc_id", F.when(k % 3 == 0, F.array(k % 5, (k + 1) % 5)).otherwise(F.array().cast("array<bigint>")).alias("chosen"),
                                 F.when(k % 3 == 1, F.array(F.lit("Banking"), F.lit("AI"))).otherwise(F.array().cast("array<string>")).alias("detected"))


def seeded(spark, d):
    return ints(L.default_domains(nations(spark, d)))


ROUTES = """select doc_id, unnest([doc_id%5, (doc_id+1)%5]) domain_id from documents where doc_id%3=0 union all
    select doc_id, unnest([row_economics, row_it]) from documents, dom where doc_id%3=1 union all
    select doc_id, row_general from documents, dom where doc_id%3=2"""
DOM = """select cast(max(r) filter (name='economics_finance') as bigint) row_economics, cast(max(r) filter (name='information_technology') as bigint) row_it,
    cast(max(r) filter (name='general') as bigint) row_general from (select name, row_number() over (order by name) + (select max(n_nationkey) from nation) r from (select unnest(['%s']) as name))""" % "','".join(
    __import__("termflow.functions.constants", fromlist=["DOMAINS"]).DOMAINS)


@query("target_domains", "U8", sql("select doc_id, domain_id from routes", dom=DOM, routes=ROUTES))
def target_domains(spark, d):
    return L.target_domains(save_docs(spark, d), seeded(spark, d))


def confirmed(spark, d):
    m = L.match_any_value(doc_terms(spark, d), library(spark, d))
    return m.select("doc_id", "pos", "source", "targets", "strategy", F.lit("").alias("ai_category"), F.lit("").alias("context"),
                    F.col("lib.id").alias("library_id"), (F.col("pos") % 2 == 0).alias("save"), (F.col("pos") % 3 == 0).alias("sync"))


WRITES = """select t.doc_id, pos, case when i.id is null then 'new' when pos%3=0 then 'update' else 'accumulate' end route,
      source, t.t_fr, t.t_de, i.id library_id from doc_terms t left join idx i on i.key = t.source
    where t.strategy <> 'skip' and (i.id is not null or pos%2=0)"""
WIDX = """select key, domain_id, id from (select *, row_number() over (partition by key, domain_id order by prio, id) r from (
        select norm key, 0 prio, domain_id, id from library union all
        select lower(trim(x.target)), 1, l.domain_id, l.id from library l join library_long x using (id) where x.target <> '')) where r = 1"""


@query("saved_terms", "U3 J3", sql("""
    select w.doc_id, pos, route, r.domain_id, k.id library_id, w.t_fr fr, source en from writes w join routes r using (doc_id)
      left join widx k on k.key = w.source and k.domain_id = r.domain_id where route = 'new'
    union all select doc_id, pos, route, null, library_id, t_fr, source from writes where route = 'update'
    union all select doc_id, pos, route, null, library_id, t_fr, null from writes where route = 'accumulate' and (coalesce(t_fr,'') <> '' or t_de <> '')
    """, "doc_terms", "library_long", idx=INDEX, writes=WRITES, dom=DOM, routes=ROUTES, widx=WIDX))
def saved_terms(spark, d):
    w = L.save_back(confirmed(spark, d), L.target_domains(save_docs(spark, d), seeded(spark, d)), library(spark, d), ["fr", "de"])
    return w.select("doc_id", "pos", "route", "domain_id", "library_id", F.col("targets")["fr"].alias("fr"), F.col("targets")["en"].alias("en"))


@query("save_summary", "A15", sql("""
    select count(*) filter (route = 'new') new_terms, count(*) filter (route = 'update') updated_terms from writes""",
    "doc_terms", "library_long", idx=INDEX, writes=WRITES))
def save_summary(spark, d):
    return L.save_summary(L.save_back(confirmed(spark, d), L.target_domains(save_docs(spark, d), seeded(spark, d)), library(spark, d), ["fr", "de"]))

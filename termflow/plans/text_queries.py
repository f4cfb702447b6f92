"""Scalar text operators over all blocks."""

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..operators import quality
from .registry import ints, query, table
from .views import blocks, docs, sql

# Some lines become a link or a bare number, so the filters have something to reject.
MIXED = ("case when block_no % 9 = 4 then concat('https://example.org/', doc_id) "
         "when block_no % 9 = 5 then concat(doc_id, '.5 %') when block_no % 9 = 6 then '-' else source_text end")
WIDE_SQL = r"[\x{2e80}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2fa1f}]"
LISTED = ("case block_no % 5 when 0 then concat('• ', source_text) when 1 then concat('(12) ', source_text) "
          "when 2 then concat('iv. ', source_text) else source_text end")
TAGGED = ("concat(source_text, case block_no % 4 when 0 then ' {name} %1$s' when 1 then concat(' {{x}} ', chr(36), '{y} %d') "
          "when 2 then ' %s' else '' end)")
TAGS_KEPT = ("concat(source_text, case block_no % 4 when 0 then ' {name}' when 1 then ' %d {{x}}' "
             "when 2 then '' else ' {extra}' end)")


@query("translatable_blocks", "P1 P2", sql(f"""
    select doc_id, block_no, cast(length(t) as bigint) chars
    from (select doc_id, block_no, {MIXED} t from blocks)
    where length(trim(t)) >= 2 and not regexp_matches(trim(t), '(?i)^(https?://\\S+|www\\.\\S+)$')
      and not regexp_matches(trim(t), '^[\\d\\s.,;:+*/=%$€£¥()\\[\\]{{}}-]+$')""", "blocks"))
def translatable_blocks(spark, d):
    b = blocks(spark, d).withColumn("t", F.expr(MIXED)).where(T.is_translatable(F.col("t")))
    return ints(b.select("doc_id", "block_no", F.length("t").alias("chars")))


@query("token_estimate", "F1", sql(f"""
    select doc_id, block_no, (5*length(regexp_replace(t, '[^' || substr('{WIDE_SQL}', 2), '', 'g'))
      + 13*len(regexp_extract_all(regexp_replace(t, '{WIDE_SQL}', '', 'g'), '\\S+'))) / 10.0 tokens
    from (select doc_id, block_no, translate(source_text, 'ou', '字語') t from blocks)""", "blocks")
    .replace("/ 10.0 tokens", "/ cast(10 as double) tokens"))
def token_estimate(spark, d):
    t = F.translate("source_text", "ou", "字語")
    return ints(blocks(spark, d).select("doc_id", "block_no", T.token_estimate(t).alias("tokens")))


CLOCK = ("case when event_id % 11 = 0 then 'n/a' else concat(hour(ts), ':', minute(ts), ':', second(ts), "
         "case event_id % 3 when 0 then ',' when 1 then '.' else ':' end, cast(floor(value * 100) as bigint)) end")


@query("clock_seconds", "F2", f"""
    with c as (select event_id, {CLOCK} c from events),
    p as (select event_id, regexp_extract(c, '^(\\d+):(\\d+):(\\d+)[:,.](\\d+)', ['h','m','s','ms']) g, c from c)
    select event_id, case when c <> 'n/a' then try_cast(g.h as int)*3600 + try_cast(g.m as int)*60 + try_cast(g.s as int)
      + try_cast(rpad(substr(g.ms,1,3),3,'0') as double)/1000 end as "seconds" from p""")
def clock_seconds(spark, d):
    return table(spark, d, "events").select("event_id", T.clock_seconds(F.expr(CLOCK)).alias("seconds"))


@query("sentence_ends", "F3", sql("""
    select lang, count(*) n_blocks, count(*) filter (regexp_matches(t, '[.!?。！？…]\\s*$')) n_ends from (
      select lang, case when block_no % 3 = 0 then replace(source_text, '.', '。') || '  '
        when block_no % 7 = 1 then source_text || ',' else source_text end t from blocks) group by lang""", "blocks"))
def sentence_ends(spark, d):
    b = blocks(spark, d).withColumn("t", F.expr(
        "case when block_no % 3 = 0 then concat(replace(source_text, '.', '。'), '  ') "
        "when block_no % 7 = 1 then concat(source_text, ',') else source_text end"))
    return b.groupBy("lang").agg(F.count("*").alias("n_blocks"), F.count_if(T.ends_sentence(F.col("t"))).alias("n_ends"))


PH_SQL = r"\{[^{}]*\}|%\d*\$?[sdfouxX]|%[sdfouxX]|\{\{[^{}]+\}\}|\$\{[^{}]+\}"


@query("placeholder_parity", "F9", sql(f"""
    with p as (select doc_id, block_no, regexp_extract_all({TAGGED}, '{PH_SQL}') a,
               regexp_extract_all({TAGS_KEPT}, '{PH_SQL}') b from blocks)
    select doc_id, block_no, cast(len(a) as bigint) expected,
      array_to_string(list_sort(list_distinct(list_filter(a, lambda x: not list_contains(b, x)))), ' ') missing,
      array_to_string(list_sort(list_distinct(list_filter(b, lambda x: not list_contains(a, x)))), ' ') added
    from p where len(list_filter(a, lambda x: not list_contains(b, x))) + len(list_filter(b, lambda x: not list_contains(a, x))) > 0
    """, "blocks").replace(" with p as (", " , p as (", 1))
def placeholder_parity(spark, d):
    b = blocks(spark, d).select("doc_id", "block_no", F.expr(TAGGED).alias("s"), F.expr(TAGS_KEPT).alias("t"))
    return ints(quality.placeholder_parity(b, "s", "t").drop("s", "t"))


@query("subtitle_line_cleanup", "F10", """
    select doc_id, md5(string_agg(case when regexp_replace(t, '[\\s,.!?;:，。！？；：、…⋯—–]+$', '') = '' then t
       else regexp_replace(t, '[\\s,.!?;:，。！？；：、…⋯—–]+$', '') end, chr(10) order by pos)) cleaned
    from (select doc_id, unnest(string_split(text || chr(10) || '...', chr(10))) t,
          generate_subscripts(string_split(text || chr(10) || '...', chr(10)), 1) pos from documents) group by doc_id""")
def subtitle_line_cleanup(spark, d):
    t = F.concat("text", F.lit("\n..."))
    return docs(spark, d).select("doc_id", F.md5(T.strip_line_ends(t)).alias("cleaned"))


@query("flattened_text", "F11", """
    select doc_id, md5(trim(regexp_replace(replace(text, chr(10), ' '), ' {2,}', ' ', 'g'))) flat,
      cast(length(trim(regexp_replace(replace(text, chr(10), ' '), ' {2,}', ' ', 'g'))) as bigint) chars from documents""")
def flattened_text(spark, d):
    flat = T.flatten(F.col("text"))
    return ints(docs(spark, d).select("doc_id", F.md5(flat).alias("flat"), F.length(flat).alias("chars")))


@query("best_text", "F12", sql("""
    select doc_id, block_no, md5(case when block_no%3=0 then '[R]' || source_text when block_no%3=1 then '[T]' || source_text
      else source_text end) best from blocks""", "blocks"))
def best_text(spark, d):
    r = F.when(F.col("block_no") % 3 == 0, F.concat(F.lit("[R]"), "source_text")).otherwise("")
    t = F.when(F.col("block_no") % 3 < 2, F.concat(F.lit("[T]"), "source_text"))
    return ints(blocks(spark, d).select("doc_id", "block_no", F.md5(T.best_text(r, t, F.col("source_text"))).alias("best")))


@query("list_items", "F13 F14", sql(f"""
    select doc_id, block_no, list_prefix, md5(list_prefix || trim(regexp_replace('[T]' || trim(
      case when list_prefix <> '' then body else t end), ' {{2,}}', ' ', 'g'))) output
    from (select doc_id, block_no, t, p.p list_prefix, p.b body from (select doc_id, block_no, {LISTED} t from blocks),
      lateral (select case when regexp_matches(t, '^((?:\\(?\\d+[).、]|[A-Za-z][).、]|[IVXLCMivxlcm]+[).、])\\s+)(.+)$')
        then regexp_extract(t, '^((?:\\(?\\d+[).、]|[A-Za-z][).、]|[IVXLCMivxlcm]+[).、])\\s+)(.+)$', ['p','b'])
        else regexp_extract(t, '^([•●▪■◆◇○◦·*-]\\s+)(.+)$', ['p','b']) end p))""", "blocks"))
def list_items(spark, d):
    t = F.col("t")
    b = blocks(spark, d).withColumn("t", F.expr(LISTED)).withColumn("list_prefix", T.list_prefix(t))
    out = T.paragraph_text(F.lit(""), F.concat(F.lit("[T]"), T.list_content(t)), t, F.col("list_prefix"))
    return ints(b.select("doc_id", "block_no", "list_prefix", F.md5(out).alias("output")))


GROWN = "concat('[T]', source_text, repeat('!', cast(length(source_text) * (block_no % 4) / 5 as int)))"


@query("expansion_report", "F15 Q7", sql(f"""
    select doc_id, block_no, round(r, 6) ratio, r > 1.5 overflows,
      round(case when r > 1.4 then greatest(8.0, 18.0 / r) else 18.0 end, 6) font_size
    from (select doc_id, block_no, length(t) / cast(length(source_text) as double) r
          from (select doc_id, block_no, source_text, {GROWN.replace('cast(', 'cast(floor(').replace(' as int', ') as int')} t from blocks)
          where length(source_text) > 0)""", "blocks"))
def expansion_report(spark, d):
    b = blocks(spark, d).withColumn("t", F.expr(GROWN)).where("length(source_text) > 0")
    r = T.expansion_ratio(F.col("source_text"), F.col("t"))
    return ints(b.select("doc_id", "block_no", F.round(r, 6).alias("ratio"), (r > K.OVERFLOW_RATIO).alias("overflows"),
                         F.round(T.fitted_font_size(F.lit(18.0), r), 6).alias("font_size")))


LANG_CODE = "case lang when 'en' then 'zh' when 'de' then 'zh-tw' when 'es' then ' ' else upper(lang) end"


@query("language_labels", "F24 F25", f"""
    with c as (select case {LANG_CODE} when 'zh' then 'zh-CN' when 'zh-tw' then 'zh-TW' when ' ' then 'en' else {LANG_CODE} end code from documents)
    select code, case code when 'zh-CN' then 'Simplified Chinese' when 'zh-TW' then 'Traditional Chinese'
      when 'en' then 'English' when 'FR' then 'French' else code end label, count(*) n from c group by all""")
def language_labels(spark, d):
    c = docs(spark, d).select(T.canonical_language(F.expr(LANG_CODE)).alias("code"))
    return c.groupBy("code", T.language_name(F.col("code")).alias("label")).agg(F.count("*").alias("n"))


@query("content_hashes", "F26", "select doc_id, substr(sha256(text), 1, 12) hash from documents")
def content_hashes(spark, d):
    return docs(spark, d).select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@query("word_counts", "A2", """
    select lang, count(*) n_docs, cast(sum(len(regexp_extract_all(text, '\\S+'))) as bigint) n_words,
      cast(max(len(regexp_extract_all(text, '\\S+'))) as bigint) max_words from documents group by lang""")
def word_counts(spark, d):
    n = T.word_count(F.col("text"))
    return docs(spark, d).groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(n).alias("n_words"), F.max(n).alias("max_words"))


RAW_DOMAIN = ("case c_custkey % 7 when 0 then c_mktsegment when 1 then 'Information-Technology' when 2 then ' Banking ' "
              "when 3 then 'chemical engineering' when 4 then 'AI' when 5 then '' else concat(lower(c_mktsegment), 'x') end")
_SYN = ", ".join(f"('{w}','{c}')" for w, c in K.DOMAIN_SYNONYMS.items())
_DOM = ", ".join(f"'{x}'" for x in K.DOMAINS)


@query("domain_normalization", "F8", f"""
    with r as (select c_custkey, {RAW_DOMAIN} raw from customer),
    k as (select *, replace(replace(lower(trim(raw)), ' ', '_'), '-', '_') key from r),
    syn(word, canon) as (values {_SYN})
    select raw, case when key in ({_DOM}) then key else coalesce(canon, 'general') end as domain, count(*) n
    from k left join syn on word = key group by all""")
def domain_normalization(spark, d):
    raw = table(spark, d, "customer").select(F.expr(RAW_DOMAIN).alias("raw"))
    return raw.groupBy("raw").agg(F.count("*").alias("n")).withColumn("domain", T.normalize_domain(F.col("raw")))


@query("term_field_validation", "F27", """
    select p_partkey, case when p_size % 5 = 0 then '' when p_size % 5 = 1 then 'brand' else 'domain_term' end ai_category,
      case when p_size % 3 = 0 then 'keep_original' when p_size % 3 = 1 then 'skip' else 'hard' end strategy from part""")
def term_field_validation(spark, d):
    from ..operators.replies import validate_fields
    p = table(spark, d, "part").select(
        "p_partkey", F.expr("case p_size % 5 when 0 then '' when 1 then 'brand' else p_type end").alias("ai_category"),
        F.expr("case p_size % 3 when 0 then 'keep_original' end").alias("strategy"),
        F.expr("case p_size % 3 when 0 then 'hard' when 1 then 'skip' end").alias("suggested_strategy"))
    return validate_fields(p).select("p_partkey", "ai_category", "strategy")

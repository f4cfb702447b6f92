"""Term extraction and term search over whole texts."""

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import labels, maps as M
from ..functions import text as T
from ..operators import extraction as E
from ..operators import matching as X
from .registry import ints, query, table
from .views import blocks, doc_terms, docs, library, sql



def langs():
    return F.array(F.lit("fr"), F.lit("de"), F.lit("es"))


@query("term_coverage", "J6 P1 A1", sql("""
    select d.lang, h.source, cast(sum(n) as bigint) occurrences, count(distinct h.doc_id) n_docs
    from lib_hits h join documents d on d.doc_id = h.doc_id where length(trim(source_text)) >= 2 group by all""", "lib_hits"))
def term_coverage(spark, d):
    """Where the library's terms occur: lines, substring search, counts per language."""
    text = F.array_join(F.filter("lines", T.is_translatable), "\n").alias("text")
    found = X.coverage(docs(spark, d).select("doc_id", "lang", text), library(spark, d).select(F.col("norm").alias("term")))
    return found.withColumnRenamed("term", "source")


@query("term_frequency", "J6", sql("""
    select doc_id, norm term, cast(sum(n) as bigint) frequency, min(block_no) first_block from lib_hits group by all""", "lib_hits"))
def term_frequency(spark, d):
    found = X.document_hits(docs(spark, d), library(spark, d).select(F.col("norm").alias("term")))
    return ints(found.drop("bounded"))


@query("bounded_term_hits", "J5 F7", sql("""
    select doc_id, count(*) n_hits, count(distinct id) n_terms from lib_hits
    where contains(t, ' ' || norm || ' ') group by doc_id""", "lib_hits").replace("from lib_hits", """from (select h.*, p.t
      from lib_hits h join (select doc_id, block_no, ' ' || regexp_replace(lower(source_text), '[^\\p{L}\\p{N}_ ]', ' | ', 'g') || ' ' t
      from blocks) p using (doc_id, block_no))"""))
def bounded_term_hits(spark, d):
    hits = X.term_hits(blocks(spark, d), library(spark, d).select(F.col("norm").alias("term")))
    return hits.where("bounded").groupBy("doc_id").agg(
        F.count("*").alias("n_hits"), F.count_distinct("term").alias("n_terms"))


ACR = ("with hit as (select doc_id, unnest(regexp_extract_all(regexp_replace(text, '[^A-Za-z0-9_\\p{L}\\p{N}]', ' ', 'g'), "
       "'\\S+')) a from documents), cnt as (select doc_id, a acronym, count(*) n from hit "
       "where regexp_full_match(a, '[A-Z]{2,8}') group by all), cand as (select * from cnt where n >= 2 and acronym not in (%s))"
       % ", ".join(f"'{a}'" for a in K.ACRONYM_STOP_LIST))


@query("acronym_counts", "A1", ACR + " select doc_id, acronym, n from cnt")
def acronym_counts(spark, d):
    return X.acronyms(docs(spark, d))


@query("acronym_candidates", "P4", ACR + " select doc_id, acronym, n from cand")
def acronym_candidates(spark, d):
    return X.acronym_candidates(X.acronyms(docs(spark, d)))


@query("asr_variants_removed", "J8 F5", ACR + """ select doc_id, acronym, n from cand a where not (length(acronym) <= 4 and exists (
    select 1 from cand b where b.doc_id = a.doc_id and b.n > a.n and levenshtein(a.acronym, b.acronym) <= 1))""")
def asr_variants_removed(spark, d):
    return X.drop_asr_variants(X.acronym_candidates(X.acronyms(docs(spark, d))))


@query("corpus_asr_variants", "J8", ACR.replace("doc_id", "lang doc_id", 1).replace("documents)", "documents)") + """
    select doc_id lang, acronym, n from cand a where not (length(acronym) <= 4 and exists (
    select 1 from cand b where b.doc_id = a.doc_id and b.n > a.n and levenshtein(a.acronym, b.acronym) <= 1))""")
def corpus_asr_variants(spark, d):
    """The same rule over everything written in one language."""
    by_lang = docs(spark, d).select(F.col("lang").alias("doc_id"), "text")
    return X.drop_asr_variants(X.acronym_candidates(X.acronyms(by_lang))).withColumnRenamed("doc_id", "lang")


REQ = "chr(10) || chr(10) || 'Acronyms found several times; extract one only if translators need guidance on it:' || chr(10) || string_agg(acronym, ', ' order by n desc, acronym)"


@query("extraction_requests", "M8", ACR + f""", h as (select doc_id, {REQ} hint from cand group by doc_id)
    select doc_id, md5('Source language: ' || lang || chr(10) || 'Target languages: fr, de' || chr(10) || chr(10) || 'Text:' || chr(10) || text || coalesce(hint, '')) request
    from documents left join h using (doc_id)""")
def extraction_requests(spark, d):
    x = docs(spark, d)
    req = E.request_text(x.select("doc_id", "lang", "text"), X.acronym_candidates(X.acronyms(x)), ["fr", "de"])
    return req.select("doc_id", F.md5("request").alias("request"))


# A reply as a model would send it: a tenth of the terms is invented, some are in the wrong script.
def proposed(spark, d):
    p = F.col("pos")
    t = doc_terms(spark, d)
    src = F.when(p == 10, F.concat("source", F.lit("-zzq"))).otherwise(F.col("source"))
    targets = F.create_map(F.lit("fr"), F.when(p % 3 == 0, F.translate("source", "aeiou", "一二三四五"))
                           .when(p % 4 == 1, src).otherwise(F.col("t_fr")), F.lit("ja"), F.lit("語"))
    return t.select("doc_id", "pos", src.alias("source"), "strategy", targets.alias("targets"))


PROPOSED = """select doc_id, pos, case when pos=10 then source || '-zzq' else source end source, strategy,
    case when pos%3=0 then translate(source, 'aeiou', '一二三四五') when pos%4=1 then case when pos=10 then source || '-zzq' else source end
    else t_fr end fr, '語' ja from doc_terms"""
CLEANED = """select p.doc_id, pos, source, strategy, frequency,
    case when strategy <> 'skip' and coalesce(f, '') = '' then source else f end fr,
    case when strategy <> 'skip' then source end de, ja from (
      select p.*, case when regexp_matches(fr, '[\\x{4e00}-\\x{9fff}]') then '' else fr end f,
        (length(d.text) - length(replace(lower(d.text), p.source, ''))) // length(p.source) frequency
      from proposed p join documents d using (doc_id)) p where frequency > 0"""


@query("cleaned_terms", "P5 P6 P7 P8 F6", sql("""
    select doc_id, pos, source, cast(frequency as bigint) frequency, strategy, fr, de from cleaned
    where strategy <> 'keep_original' or (fr <> '' and fr <> source) or (de <> '' and de <> source) or ja <> source
    """, "doc_terms", proposed=PROPOSED, cleaned=CLEANED))
def cleaned_terms(spark, d):
    counted = E.count_in_own_document(proposed(spark, d), docs(spark, d))
    out = E.clean_terms(counted, F.array(F.lit("fr"), F.lit("de")))
    return out.select("doc_id", "pos", "source", "frequency", "strategy",
                      F.col("targets")["fr"].alias("fr"), F.col("targets")["de"].alias("de"))


@query("asr_pruned_terms", "W19", None)
def asr_pruned_terms(spark, d):
    """Order-dependent pruning over each document's acronyms, most frequent first."""
    from pyspark.sql import Window
    a = X.acronyms(docs(spark, d)).withColumn("pos", F.row_number().over(
        Window.partitionBy("doc_id").orderBy("acronym")))
    return E.prune_asr_duplicates(a.select("doc_id", "pos", F.col("acronym").alias("source"), F.col("n").alias("frequency")))


@query("gap_terms", "P16 J14", sql("""
    select doc_id, pos, source, concat_ws(',', case when coalesce(t_fr,'')='' then 'fr' end, case when t_de='' then 'de' end, 'es') missing
    from doc_terms where strategy <> 'skip'""", "doc_terms"))
def gap_terms(spark, d):
    g = E.gap_terms(doc_terms(spark, d), langs())
    return g.select("doc_id", "pos", "source", F.array_join("missing", ",").alias("missing"))


@query("filled_gaps", "J14 F-MAP4", sql("""
    select doc_id, pos, case when coalesce(t_fr,'')='' and pos%2=0 then upper(source) else t_fr end fr,
      case when t_de='' and pos%2=0 then upper(source) else t_de end de, case when pos%2=0 then upper(source) end es,
      not (pos%2=0) uncertain, case when pos%2=0 then '' else 'MISSING' end note from doc_terms""", "doc_terms"))
def filled_gaps(spark, d):
    t = doc_terms(spark, d).withColumn("uncertain", F.lit(True)).withColumn("uncertainty_note", F.lit("MISSING"))
    replies = t.where("pos % 2 = 0").select("doc_id", "source", F.explode(langs()).alias("lang"), F.upper("source").alias("target"))
    out = E.fill_gaps(t, replies, langs())
    m = F.col("targets")
    return out.select("doc_id", "pos", m["fr"].alias("fr"), m["de"].alias("de"), m["es"].alias("es"),
                      "uncertain", F.col("uncertainty_note").alias("note"))


@query("parsed_term_replies", "JS1 F8 F27", """
    with r as (select doc_id, substr(text, 1, 6) w, doc_id % 5 k from documents)
    select doc_id, cast(p as bigint) pos, 'term' || p source, case when p=1 then 'skip' else 'hard' end strategy,
      case when p=0 then 'domain_term' else '' end ai_category, 'x' || p fr from r, range(0, 3) t(p)
    where k <> 4 and p <> 2""")
def parsed_term_replies(spark, d):
    terms, _, _ = reply_parts(spark, d)
    return ints(terms.select("doc_id", "pos", "source", "strategy", "ai_category", F.col("targets")["fr"].alias("fr")))


def reply_parts(spark, d):
    from ..operators.replies import parse_term_replies
    terms = ('[{"source":"term0","targets":{"fr":"x0"},"ai_category":"finance"},{"source":"term1","targets":{"fr":"x1"},'
             '"suggested_strategy":"skip"},{"target":"no source"}]')
    k = F.col("doc_id") % 5
    reply = (F.when(k == 0, F.lit(terms)).when(k == 1, F.lit("```json\n{\"document_domains\": [\"Banking\", \"\", \"AI\"], \"terms\": %s}\n```" % terms))
             .when(k == 2, F.lit("Here it is: {\"document_domain\": \"law\", \"terms\": %s} done" % terms))
             .when(k == 3, F.lit("{\"terms\": %s}" % terms)).otherwise(F.concat(F.lit("sorry { "), F.substring("text", 1, 6))))
    return parse_term_replies(docs(spark, d).select("doc_id", reply.alias("reply")))


@query("parsed_reply_domains", "JS1 F8", """
    select doc_id, cast(0 as bigint) pos, case doc_id%5 when 1 then 'economics_finance' when 2 then 'law' else 'general' end as domain from documents
    union all select doc_id, 1, 'information_technology' from documents where doc_id%5=1""")
def parsed_reply_domains(spark, d):
    return ints(reply_parts(spark, d)[1])


@query("rejected_replies", "JS1 Q1", "select doc_id from documents where doc_id % 5 = 4")
def rejected_replies(spark, d):
    return reply_parts(spark, d)[2].select("doc_id")


@query("gap_reply_rows", "JS2", """
    select p_partkey, p_name source, 'fr' lang, p_type target from part union all select p_partkey, p_name, 'de', p_brand from part""")
def gap_reply_rows(spark, d):
    from ..operators.replies import parse_gap_replies
    body = F.to_json(F.array(F.struct(F.col("p_name").alias("source"), F.create_map(
        F.lit("fr"), F.col("p_type"), F.lit("de"), F.col("p_brand"), F.lit("es"), F.lit("")).alias("translations"))))
    r = table(spark, d, "part").select("p_partkey", F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("reply"))
    return parse_gap_replies(r, "p_partkey")


@query("assistant_texts", "JS4", "select conv_id, turn, md5(text) reply from conversations")
def assistant_texts(spark, d):
    from ..operators.replies import assistant_text
    c = table(spark, d, "conversations")
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("role"), F.col("text").alias("content")).alias("message"))).alias("choices")))
    return c.select("conv_id", "turn", F.md5(assistant_text(body)).alias("reply"))


@query("language_detection", "ML1", """
    with w as (select doc_id, lang, unnest(regexp_extract_all(lower(text), '[\\p{L}]+')) word from documents),
    c as (select lang guess, word, count(*) n from w group by all), t as (select guess, sum(n) total from c group by guess),
    p as (select guess, word, cast(round(ln(n / cast(total as double)) * 1000) + 12000 as bigint) weight from c join t using (guess)),
    s as (select doc_id, guess, sum(n * weight) score from (select doc_id, word, count(*) n from w group by all) join p using (word) group by all),
    b as (select doc_id, guess, row_number() over (partition by doc_id order by score desc, guess desc) r from s)
    select lang, coalesce(guess, 'en') guess, count(*) n from documents left join (select * from b where r = 1) using (doc_id) group by all""")
def language_detection(spark, d):
    from ..operators.language import accuracy, detect, word_profiles
    x = docs(spark, d)
    return accuracy(detect(x, word_profiles(x)), x)

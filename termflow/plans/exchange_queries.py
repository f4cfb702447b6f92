"""Payloads, replies, retries, review and cache."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import exchange as X
from ..operators import segments as S
from .registry import ints, query, table
from .segment_queries import GEN_CTE, general, with_blocks
from .views import docs, sql

# Six ways a reply can come back, by segment: faithful, last block dropped, one text blanked,
# noise with an invented id, an inline end marker, no markers at all.
KIND = "(doc_id * 7 + segment_no) % 6"


def segments(spark, d):
    return S.segment_rows(general(spark, d))


def replies(spark, d):
    seg = segments(spark, d).withColumn("kind", F.expr(KIND).cast("int"))
    n = F.size("blocks")

    def piece(b, i):
        marked = F.concat(F.lit("[[BLOCK:"), b["block_id"], F.lit("]]\n"))
        text = F.concat(F.lit("[T]"), b["text"])
        k = F.col("kind")
        return (F.when((k == 1) & (i == n - 1), "").when((k == 2) & (i == 0), F.concat(marked, F.lit("  ")))
                .when(k == 4, F.concat(marked, F.lit("<!-- group: x -->"), text, F.lit(" [[END]] more\n[[END]]\nrest")))
                .when(k == 5, text).otherwise(F.concat(marked, text)))
    body = F.array_join(F.transform("blocks", piece), "\n\n")
    noise = F.when(F.col("kind") == 3, F.lit("Sure:\n[[BLOCK:ghost]]\nboo\n")).otherwise("")
    return seg.withColumn("reply", F.concat(noise, body, F.lit("\n\n[[END]]\n")))


READ = f"""select *, (doc_id*7+sn)%6 kind, count(*) over (partition by doc_id, sn) n, row_number() over (partition by doc_id, sn order by i) rn from gen"""
PARSED = r"""select doc_id, sn segment_no, 'b' || i block_id, n, case
    when trim(t) = '' and kind not in (4) then null
    when kind = 1 and rn = n and n > 1 then null when kind = 2 and rn = 1 and n > 1 then null
    when kind = 4 then '[T]' || t || ' [[END]] more' || chr(10) || '[[END]]' || chr(10) || 'rest'
    when kind = 5 and n > 1 then null when kind = 1 and n = 1 then null when kind = 2 and n = 1 then '[[BLOCK:b' || i || ']]' else '[T]' || trim(t) end tx from rd"""


@query("marked_payloads", "M1 W18 P2", sql("""
    select doc_id, sn segment_no, md5(string_agg(case when g is not null and g is distinct from pg then '<!-- group: ' || g || ' -->' || chr(10) else '' end
      || '[[BLOCK:b' || i || ']]' || chr(10) || t, chr(10) || chr(10) order by i) || chr(10) || chr(10) || '[[END]]') payload
    from (select gen.*, tb.g, lag(tb.g) over (partition by gen.doc_id, sn order by gen.i) pg from gen join tb on tb.doc_id = gen.doc_id and tb.i = gen.i) group by all""",
    "blocks", **GEN_CTE))
def marked_payloads(spark, d):
    return ints(segments(spark, d).select("doc_id", "segment_no", F.md5(X.payload(F.col("blocks"))).alias("payload")))


@query("parsed_replies", "M2 M3 J11", sql("select doc_id, segment_no, block_id, md5(tx) text from parsed where tx is not null and trim(tx) <> ''",
       "blocks", **GEN_CTE, rd=READ, parsed=PARSED))
def parsed_replies(spark, d):
    t = X.translations(X.read_replies(replies(spark, d)))
    return ints(t.select("doc_id", "segment_no", "block_id", F.md5("text").alias("text")))


@query("missing_blocks", "J11 M4", sql("select doc_id, segment_no, block_id from parsed where tx is null", "blocks", **GEN_CTE, rd=READ, parsed=PARSED))
def missing_blocks(spark, d):
    return ints(X.missing_blocks(X.read_replies(replies(spark, d))))


@query("match_ratios", "A16", sql("""
    select doc_id, segment_no, max(n) expected, count(tx) matched, round(count(tx) / cast(max(n) as double), 6) ratio from parsed group by all""",
    "blocks", **GEN_CTE, rd=READ, parsed=PARSED))
def match_ratios(spark, d):
    r = X.match_ratios(X.read_replies(replies(spark, d)))
    return ints(r.withColumn("ratio", F.round("ratio", 6)))


def stubborn_model(requests):
    """Loses the last block of every third segment on pass 1 and of every sixth on pass 2."""
    out = X.echo_model(requests)
    n = requests["doc_id"] + requests["segment_no"]
    lose = ((requests["attempt"] == 1) & (n % 3 == 0)) | ((requests["attempt"] == 2) & (n % 6 == 0)) | (
        (requests["attempt"] == 3) & (n % 12 == 0))
    cut = out.str.replace(r"(?s)(?:^|\n\n)(?:<!-- [^\n]* -->\n)?\[\[BLOCK:[\w\-]+\]\]\n(?:(?!\[\[BLOCK:).)*\Z", "\n\n[[END]]", regex=True)
    return out.where(~lose, cut)


@query("translated_blocks", "M4 M5", sql("""
    select doc_id, sn segment_no, 'b' || i block_id, md5('[T]' || trim(t)) translated,
      cast(case when (doc_id+sn)%12=0 then 4 when (doc_id+sn)%6=0 then 3 when (doc_id+sn)%3=0 then 2 else 1 end as bigint) as "pass"
    from gen""", "blocks", **GEN_CTE))
def translated_blocks(spark, d):
    done, _ = X.translate(segments(spark, d), stubborn_model)
    return ints(done.select("doc_id", "segment_no", "block_id", F.md5("translated_text").alias("translated"), "pass"))


def reviewed(spark, d):
    """Drafts go back as replies in which every fourth block is reworded and one in nine is lost."""
    seg = segments(spark, d).withColumn("blocks", F.transform("blocks", lambda b: F.struct(
        b["block_id"].alias("block_id"), b["block_no"].alias("block_no"), b["group_id"].alias("group_id"), b["text"].alias("source_text"),
        F.concat(F.lit("[T]"), T.strip(b["text"])).alias("text"))))
    back = F.concat(F.array_join(F.transform("blocks", lambda b: F.when(b["block_no"] % 9 == 8, "").otherwise(F.concat(
        F.lit("[[BLOCK:"), b["block_id"], F.lit("]]\n"), F.when(b["block_no"] % 4 == 1, F.replace(b["text"], F.lit(","), F.lit("‡‡"))).otherwise(b["text"])))), "\n\n"),
        F.lit("\n\n[[END]]"))
    return X.review_changes(X.read_replies(seg.withColumn("reply", back)))


CHG = """select doc_id, sn segment_no, i, 'b' || i block_id, t, '[T]' || trim(t) b, case when i%4=1 and i%9<>8 then replace('[T]' || trim(t), ',', '‡‡') else '[T]' || trim(t) end a from gen"""


@query("review_changes", "M6", sql("""
    select doc_id, segment_no, block_id, a <> b changed, md5(a) after, case when a <> b then md5(b) else md5('') end "before" from chg""",
    "blocks", **GEN_CTE, chg=CHG))
def review_changes(spark, d):
    c = reviewed(spark, d)
    return ints(c.select("doc_id", "segment_no", "block_id", "changed", F.md5("after").alias("after"), F.md5("before").alias("before")))


@query("changed_block_counts", "A13", sql("""
    select doc_id, count(*) filter (a <> b) changed_blocks, count(*) blocks from chg group by doc_id""", "blocks", **GEN_CTE, chg=CHG).replace("count(*) blocks", 'count(*) as "blocks"'))
def changed_block_counts(spark, d):
    return X.changed_counts(reviewed(spark, d), ["doc_id"])


@query("review_diffs", "DIFF1 SNK11", sql("""
    select doc_id, block_id, md5(replace(replace(replace(replace(b, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), ',', '<del>,</del><ins>‡‡</ins>')) diff
    from chg where a <> b""", "blocks", **GEN_CTE, chg=CHG))
def review_diffs(spark, d):
    c = reviewed(spark, d).where("changed")
    m = X.marked_diff(X.token_diff(c, ["doc_id", "block_id"]), ["doc_id", "block_id"])
    return m.select("doc_id", "block_id", F.md5("diff").alias("diff"))


@query("merged_blocks", "J10 F12", sql("""
    select doc_id, block_no, md5(case when block_no%5=0 and source_text <> '' then '[R]' || source_text when block_no%3=0 and source_text <> '' then '[T]' || source_text else source_text end) best
    from blocks""", "blocks"))
def merged_blocks(spark, d):
    b = S.block_rows(segments(spark, d)).select("doc_id", "block_no", "block_id", F.col("text").alias("source_text"))
    mark = lambda m, c: F.when(F.col("source_text") == "", "").otherwise(F.concat(F.lit(m), "source_text")).alias(c)
    t = b.where("block_no % 3 = 0").select("doc_id", "block_id", mark("[T]", "translated_text"))
    r = b.where("block_no % 5 = 0").select("doc_id", "block_id", mark("[R]", "reviewed_text"))
    m = X.merge_blocks(b, t, r)
    return ints(m.select("doc_id", "block_no", F.md5(T.best_text(F.col("reviewed_text"), F.col("translated_text"), F.col("source_text"))).alias("best")))


@query("cached_answers", "J16 M7 F26", """
    select doc_id, exists (select 1 from documents p where p.text = d.text and p.doc_id % 3 = 0) hit, md5('[T]' || text) reply from documents d""")
def cached_answers(spark, d):
    """Every document is a request; texts of every third document were answered before."""
    x = docs(spark, d).select("doc_id", "text")
    old = x.where("doc_id % 3 = 0").select(T.request_key(F.col("text")).alias("request_key"), F.concat(F.lit("[T]"), "text").alias("reply"))
    old = old.groupBy("request_key").agg(F.min("reply").alias("reply"))
    got, _ = X.answer(x, old, lambda r: "[T]" + r["text"], ["text"])
    return got.select("doc_id", "hit", F.md5("reply").alias("reply"))


@query("cache_counts", "M7", """
    select count(*) filter (h) hits, count(*) filter (not h) misses, count(distinct case when not h then text end) asked from (
      select text, exists (select 1 from documents p where p.text = d.text and p.doc_id % 3 = 0) h from documents d)""")
def cache_counts(spark, d):
    x = docs(spark, d).select("doc_id", "text")
    old = x.where("doc_id % 3 = 0").select(T.request_key(F.col("text")).alias("request_key"), F.lit("x").alias("reply")).distinct()
    got, _ = X.answer(x, old, lambda r: "[T]" + r["text"], ["text"])
    return got.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"),
                   F.count_distinct(F.when(~F.col("hit"), F.col("request_key"))).alias("asked"))


@query("system_prompts", "M9 P15", """
    select doc_id, md5('From ' || case lang when 'en' then 'English' when 'fr' then 'French' when 'de' then 'German' else 'Spanish' end || ' to Thai. Terms: none. '
      || case lang when 'en' then 'Split long sentences.' else '' end) prompt from documents""")
def system_prompts(spark, d):
    x = docs(spark, d)
    notes = spark.createDataFrame([("en", "Split long sentences."), ("th", "Use classifiers.")], "code string, notes string")
    j = x.join(F.broadcast(notes), F.lower(x["lang"]) == notes["code"], "left")
    p = X.system_prompt(F.lit("From {source} to {target}. Terms: {terms}. {notes}"), {
        "source": T.language_name(F.col("lang")), "target": T.language_name(F.lit("TH")), "terms": F.lit("none"), "notes": F.col("notes")})
    return j.select("doc_id", F.md5(p).alias("prompt"))


@query("text_requests", "P18 J18 P14", """
    select doc_id, l.l target_lang, l.l in ('fr', 'JA') review from documents, (values ('fr'), ('JA'), ('ko')) l(l) where lang <> 'fr' or l.l <> 'fr'""")
def text_requests(spark, d):
    """Documents ask for a comma list of languages; review is on for two of them."""
    from ..operators.jobs import fan_out, review_enabled
    asks = F.when(F.col("lang") == "fr", " JA, ,ko").otherwise("fr ,JA,, ko ")
    r = fan_out(docs(spark, d).select("doc_id", asks.alias("languages")), "languages")
    return r.select("doc_id", "target_lang", review_enabled(F.col("target_lang"), ["FR", "ja"]).alias("review"))


@query("text_results", "A17 A18", """
    select turn, arg_min(case role when 'user' then 'en' else 'fr' end, conv_id) filter (conv_id % 2 = 1) source_lang,
      round(sum(length(text)) / 7.0, 2)::double as "seconds", count(*) filter (text <> '') succeeded from conversations group by turn""")
def text_results(spark, d):
    from ..operators.jobs import text_summary
    c = table(spark, d, "conversations").select(
        "turn", F.col("conv_id").alias("pos"), F.when(F.col("conv_id") % 2 == 1, F.when(F.col("role") == "user", "en").otherwise("fr")).otherwise("").alias("source_lang"),
        F.col("text").alias("translated"), F.length("text").alias("secs"))
    return text_summary(c.withColumn("elapsed", F.col("secs")), ["turn"]).withColumn("seconds", F.round(F.col("elapsed") / 7, 2)).drop("elapsed")

"""Jobs, runs, versions and progress."""

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import labels as L
from ..functions import text as T
from ..operators import jobs as J
from .registry import ints, query, table
from .views import doc_terms, job_runs, jobs, progress, sql

AS_OF = "timestamp '1998-08-02 12:00:00'"
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "segments_total", "l_shipdate"]
PCT = """case when status in ('done','error','cancelled') then 100 when segments_total <= 0 then case when status='reviewing' then 50 else 0 end
    when status='reviewing' then least(99, 50 + floor(segments_done / segments_total::double * 50)) else least(50, floor(segments_done / segments_total::double * 50)) end"""
ROLL = f"""select job_id, count(*) n_runs, count(*) filter (status='done') n_done, count(*) filter (status='error') n_error,
    count(*) filter (status in ('done','error','cancelled')) n_terminal, count(*) filter (status in ('translating','reviewing','rebuilding')) n_active,
    cast(sum(segments_done) as bigint) segments_done, cast(sum(segments_total) as bigint) segments_total, sum({PCT}) p,
    bool_or(status='rebuilding') rb, bool_or(status='reviewing') rv,
    array_to_string(list_slice(list(target_lang order by {', '.join(ORDER)}) filter (status in ('translating','reviewing','rebuilding')), 1, 3), ', ') shown
    from job_runs group by job_id"""


@query("job_rollup", "A7 T8 F22", sql("""
    select job_id, n_runs, n_done, n_error, n_terminal, segments_done, segments_total, cast(least(99, 15 + floor(p * 84 / (n_runs*100))) as bigint) percent,
      case when rb then 'rebuilding' when rv then 'reviewing' when n_active > 0 then 'translating' when n_terminal = n_runs then 'done' else 'translating' end status,
      coalesce(shown, '') || case when n_active > 3 then ' +' || (n_active - 3) else '' end current_range from roll""", "job_runs", roll=ROLL))
def job_rollup(spark, d):
    return J.rollup_runs(job_runs(spark, d), ORDER)


@query("job_outcomes", "A8", sql("""
    select job_id, case when n_done>0 and n_error=0 then 'complete' when n_done>0 then 'partial' else 'failed' end outcome,
      case when n_done>0 then 'done' else 'error' end final_status, n_done, n_error from roll""", "job_runs", roll=ROLL))
def job_outcomes(spark, d):
    return J.outcomes(J.rollup_runs(job_runs(spark, d), ORDER))


LAB = f"""select *, case when status='error' then 'error' when status in ('done','cancelled') then 'completed' else 'active' end category,
    lower(regexp_extract(filename, '\\.[^.]+$')) extension, coalesce(created_at, started_at, completed_at) sort_time,
    case when t is null then 'unknown' when t >= date_trunc('day', {AS_OF}) then 'today' when t >= date_trunc('day', {AS_OF}) - interval 1 day then 'yesterday'
      when t >= date_trunc('day', {AS_OF}) - interval 7 day then 'last7Days' when t >= date_trunc('day', {AS_OF}) - interval 30 day then 'last30Days' else 'older' end bucket
    from (select *, coalesce(created_at, completed_at, started_at) t from jobs)"""


def labelled(spark, d):
    return J.with_labels(jobs(spark, d), F.expr(AS_OF))


@query("job_groups", "A10 F17 F18 F19", sql("""
    select category, bucket, count(*) n from lab group by grouping sets ((category, bucket), (category))""", "jobs", lab=LAB))
def job_groups(spark, d):
    return J.group_counts(labelled(spark, d), "category", "bucket")


@query("job_type_groups", "A10", sql("select extension, category, count(*) n from lab group by grouping sets ((extension, category), (extension))", "jobs", lab=LAB))
def job_type_groups(spark, d):
    return J.group_counts(labelled(spark, d), "extension", "category")


@query("filtered_jobs", "P12", sql("""
    select job_id, category, extension, bucket from lab where lower(filename) like '%1%.d%' and category in ('active','error') and bucket in ('last30Days','older')""", "jobs", lab=LAB)
    .replace("like '%1%.d%'", "like '%5.docx%'"))
def filtered_jobs(spark, d):
    f = J.filter_jobs(labelled(spark, d), "5.DOCX", ["active", "error"], [".docx", ".srt"], ["last30Days", "older"])
    return f.select("job_id", "category", "extension", "bucket")


@query("newest_jobs", "T4 SRC15", sql("""
    select job_id, strftime(sort_time, '%Y-%m-%d %H:%M:%S') sort_time, row_number() over (order by l.sort_time desc nulls last, job_id) rank
    from lab l""", "jobs", lab=LAB))
def newest_jobs(spark, d):
    r = J.newest_first(labelled(spark, d))
    return r.select("job_id", F.date_format("sort_time", "yyyy-MM-dd HH:mm:ss").alias("sort_time"), "rank")


@query("job_listing", "T5", sql("""
    select job_id, category, row_number() over (order by case category when 'active' then 0 when 'error' then 1 else 2 end, l.sort_time desc nulls last, job_id) rank
    from lab l""", "jobs", lab=LAB))
def job_listing(spark, d):
    return J.listing(labelled(spark, d)).select("job_id", "category", "rank")


@query("job_file_types", "A11", sql("select distinct extension from lab where extension <> ''", "jobs", lab=LAB))
def job_file_types(spark, d):
    return J.file_types(labelled(spark, d))


@query("phase_funnel", "F21", sql("""
    select phase, state, count(*) n from (
      select 'glossary' phase, case when status in ('parsing','terminology','awaiting_glossary_review') then 'active'
        when status in ('translating','rebuilding','reviewing','done') then 'done' else 'pending' end state from jobs where use_glossary
      union all select 'translation', case when status in ('translating','rebuilding') then 'active' when status in ('reviewing','done') then 'done' else 'pending' end from jobs)
    group by all""", "jobs"))
def phase_funnel(spark, d):
    return J.phase_funnel(jobs(spark, d))


@query("step_funnel", "F21", sql("""
    select step, state, count(*) n from (
      select 'extract' step, case when status in ('parsing','terminology') then 'active' when status in ('awaiting_glossary_review','translating','rebuilding','reviewing','done') then 'done' else 'pending' end state from jobs where use_glossary
      union all select 'confirm', case when status = 'awaiting_glossary_review' then 'active' when status in ('translating','rebuilding','reviewing','done') then 'done' else 'pending' end from jobs where use_glossary
      union all select 'translate', case when status in ('translating','rebuilding') then 'active' when status in ('reviewing','done') then 'done' else 'pending' end from jobs
      union all select 'review', case when status = 'reviewing' then 'active' when status = 'done' then 'done' else 'pending' end from jobs
      union all select 'complete', case when status = 'done' then 'done' else 'pending' end from jobs) group by all""", "jobs"))
def step_funnel(spark, d):
    return J.step_funnel(jobs(spark, d))


@query("durations", "F20", """
    select event_id, case when s < 0 then '' when s < 1 then '<1s' when s < 60 then cast(floor(s+0.5) as bigint) || 's'
      when s < 3600 then cast(floor(s/60) as bigint) || 'm' || lpad('' || cast(floor(s - 60*floor(s/60) + 0.5) as bigint), 2, '0') || 's'
      else cast(floor(s/3600) as bigint) || 'h' || lpad('' || cast(floor((s - 3600*floor(s/3600))/60 + 0.5) as bigint), 2, '0') || 'm' end duration
    from (select event_id, value * (event_id % 200) - 3 s from events)""")
def durations(spark, d):
    s = F.col("value") * (F.col("event_id") % 200) - 3
    return table(spark, d, "events").select("event_id", L.duration_text(s).alias("duration"))


@query("live_over_history", "J12 U1", sql("""
    select job_id, 'live' origin from jobs where job_id % 3 = 0 union all select job_id, 'stored' from jobs where job_id % 3 <> 0""", "jobs"))
def live_over_history(spark, d):
    j = jobs(spark, d)
    live = j.where("job_id % 3 = 0").withColumn("origin", F.lit("live"))
    return J.live_over_history(live, j.where("job_id % 3 <> 0 or job_id % 2 = 0").withColumn("origin", F.lit("stored"))).select("job_id", "origin")


@query("saved_jobs", "SNK9", sql("""
    select job_id, case when job_id % 5 = 0 then 'cancelled' else status end status from jobs""", "jobs"))
def saved_jobs(spark, d):
    j = jobs(spark, d)
    return J.save_jobs(j.where("job_id % 5 <> 0 or job_id % 2 = 0"), j.where("job_id % 5 = 0").withColumn("status", F.lit("cancelled"))).select("job_id", "status")


def run_files(spark, d):
    link = lambda pre: F.concat(F.lit("/api/download/"), "job_id", F.lit(pre), "target_lang", F.lit(".txt"))
    return job_runs(spark, d).select("job_id", "status", F.when(F.col("l_linenumber") % 5 == 0, "").otherwise(link("/out_")).alias("download_url"),
                                     F.when(F.col("l_linenumber") % 3 == 0, link("x/draft_")).otherwise(link("/draft_")).alias("draft_download_url"))


@query("stored_outputs", "J17", sql("""
    select job_id, 'out_' || target_lang || '.txt' filename, 'jobs/' || job_id || '/output/out_' || target_lang || '.txt' path from job_runs where status='done' and l_linenumber%5<>0
    union all select job_id, 'draft_' || target_lang || '.txt', 'jobs/' || job_id || '/output/draft_' || target_lang || '.txt' from job_runs where status='done' and l_linenumber%3<>0""", "job_runs"))
def stored_outputs(spark, d):
    return J.outputs(run_files(spark, d))


@query("outputs_after_delete", "U10", sql("""
    select job_id, count(*) n from (
      select job_id from job_runs where status='done' and l_linenumber%5<>0 union all select job_id from job_runs where status='done' and l_linenumber%3<>0)
    where job_id not in (select o_orderkey from orders where o_orderstatus = 'F') group by job_id""", "job_runs"))
def outputs_after_delete(spark, d):
    j = jobs(spark, d)
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("job_id"))
    return J.delete_jobs(j, J.outputs(run_files(spark, d)), gone)[1].groupBy("job_id").agg(F.count("*").alias("n"))


@query("top_glossary_rows", "T7", """
    select job_id, source, rank from (select l_orderkey % 50 job_id, l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey source,
      row_number() over (partition by l_orderkey % 50 order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey, l_suppkey) rank from lineitem) where rank <= 20""")
def top_glossary_rows(spark, d):
    r = table(spark, d, "lineitem").withColumn("job_id", F.col("l_orderkey") % 50)
    o = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    return ints(J.top_rows_per_job(r, o).select("job_id", F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("source"), "rank"))


@query("job_fan_out", "J18", sql("select job_id, l.l target_lang from jobs, (values ('fr'), ('de'), ('ja')) l(l)", "jobs"))
def job_fan_out(spark, d):
    return J.fan_out_jobs(jobs(spark, d), ["fr", "de", "ja"]).select("job_id", "target_lang")


STG = """select *, sum(nw) over (partition by run_id order by ts, event_id) stage from (
    select *, case when status not in ('done','error') and status is distinct from lag(status) over (partition by run_id order by ts, event_id) then 1 else 0 end nw from progress)"""


@query("stage_timing", "F23 S2", sql("""
    select run_id, event_id, status, round(el, 3) elapsed, round(case when ok then el / segments_done end, 3) per_segment,
      round(case when status='done' then 0.0::double when ok then greatest(0, 100 - segments_done) * (el / segments_done) end, 3) eta from (
      select *, epoch_us(ts) el0, (epoch_us(ts) - epoch_us(min(case when nw=1 then ts end) over (partition by run_id, stage))) / 1e6::double el,
        status = 'translating' and segments_done > 0 and nw = 0 ok from stg)""", "progress", stg=STG))
def stage_timing(spark, d):
    t = J.stage_timing(progress(spark, d), F.lit(100), F.date_trunc("day", F.col("ts")))
    return t.select("run_id", "event_id", "status", *[F.round(c, 3).alias(c) for c in ("elapsed", "per_segment", "eta")])


def contents(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, d, "events").select(F.concat(F.lit("p"), F.col("user_id")).alias("name"), "ts", "event_id",
                                            T.content_hash((k % 3).cast("string")).alias("hash"), "value")


VER = """select name, ts, event_id, hash, value, row_number() over (partition by name order by ts, event_id) version_no from (
    select *, lag(hash) over (partition by name order by ts, event_id) p from (select 'p' || user_id as name, ts, event_id, value,
      substr(sha256('' || (cast(json_extract_string(props, '$.k') as bigint) % 3)), 1, 12) hash from events)) where hash is distinct from p"""


@query("version_history", "W15 W16", sql("select name, event_id, hash, version_no, name || '_v' || version_no version_id from ver", ver=VER))
def version_history(spark, d):
    return J.versions(contents(spark, d), F.date_trunc("day", F.col("ts"))).drop("ts")


@query("latest_versions", "W16", sql("""
    select name, name || '_v' || max(version_no) version_id, arg_max(hash, version_no) hash,
      (select round(arg_max(e.value, e.event_id), 3) from events e where 'p' || e.user_id = ver.name and e.event_type = 'click') click_score
    from ver group by name""", ver=VER))
def latest_versions(spark, d):
    c = contents(spark, d)
    s = table(spark, d, "events").select(F.concat(F.lit("p"), F.col("user_id")).alias("name"), F.col("event_type").alias("test_id"), F.col("value").alias("score"), "event_id")
    v = J.latest_versions(J.versions(c, F.date_trunc("day", F.col("ts"))), s)
    return v.select("name", "version_id", "hash", F.round(F.col("scores")["click"], 3).alias("click_score"))

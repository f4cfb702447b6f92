"""Structured Streaming runs over the given tables, compared with their batch twins."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import plain as P
from ..streaming import progress as S
from .job_queries import STG
from .registry import ints, query, table
from .views import shape_progress, sql

TS = "CAST(ts AS TIMESTAMP)"


def events(spark, d):
    return S.source(spark, d, "events").withColumn("ts", F.expr(TS))


def runs(e):
    return shape_progress(e).withColumn("segments_total", F.lit(100).cast("bigint")).withColumn("target_lang", F.concat(F.lit("l"), F.col("run_id")))


LATEST = """select run_id, arg_max(job_id, (ts, event_id)) job_id, arg_max(status, (ts, event_id)) status, arg_max(segments_done, (ts, event_id)) sd from progress group by run_id"""


@query("live_job_rollup", "S1 A7", sql("""
    select job_id, count(*) n_runs, count(*) filter (status='done') n_done, cast(sum(sd) as bigint) segments_done,
      case when count(*) filter (status in ('queued','translating')) > 0 then 'translating' when count(*) filter (status in ('done','error')) = count(*) then 'done' else 'translating' end status
    from latest group by job_id""", "progress", latest=LATEST))
def live_job_rollup(spark, d):
    r = S.live_rollup(runs(events(spark, d)))
    return r.select("job_id", "n_runs", "n_done", "segments_done", "status")


@query("live_stage_timing", "S2 F23", sql("""
    select run_id, event_id, round(el, 3) elapsed, round(case when status='done' then 0.0::double when ok then greatest(0, 100 - segments_done) * (el / segments_done) end, 3) eta from (
      select *, (epoch_us(ts) - epoch_us(min(case when nw=1 then ts end) over (partition by run_id, stage))) / 1e6::double el,
        status = 'translating' and segments_done > 0 and nw = 0 ok from stg)""", "progress", stg=STG))
def live_stage_timing(spark, d):
    t = S.live_timing(runs(events(spark, d)), F.lit(100))
    return t.select("run_id", "event_id", F.round("elapsed", 3).alias("elapsed"), F.round("eta", 3).alias("eta"))


SESS = """select user_id, ts, event_id, case when ts > max(e) over w or max(e) over w is null then 1 else 0 end nw from (
      select *, ts + (value + 3600) * interval 1 second e from events) window w as (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding)"""


@query("live_cue_sessions", "S3", sql("""
    select key, strftime(s, '%Y-%m-%d %H:%M:%S') session_start, strftime(e, '%Y-%m-%d %H:%M:%S') session_end, n_cues from (
      select user_id key, min(ts) s, count(*) n_cues, max(ts + (value + 3600) * interval 1 second) e from (
        select x.*, y.value, sum(nw) over (partition by x.user_id order by x.ts, x.event_id) k from sess x join events y using (event_id)) group by user_id, k)""",
    sess=SESS))
def live_cue_sessions(spark, d):
    c = events(spark, d).select(F.col("user_id").alias("key"), F.col("ts").alias("start_at"), F.col("value").alias("seconds"))
    s = S.cue_sessions(c, 3600)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return s.select("key", text("session_start"), text("session_end"), "n_cues")


LAGS = """select user_id, ts, event_id, case when lag(ts + value * interval 1 second) over w is null or ts > lag(ts + value * interval 1 second) over w + interval 1 hour then 1 else 0 end nw
    from events window w as (partition by user_id order by ts, event_id)"""


@query("cue_sessions", "W3 S3", sql("""
    select key, cast(k as bigint) session_no, strftime(min(ts), '%Y-%m-%d %H:%M:%S') session_start, count(*) n_cues from (
      select user_id key, ts, sum(nw) over (partition by user_id order by ts, event_id) k from lags) group by key, k""", lags=LAGS))
def cue_sessions(spark, d):
    c = table(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", F.expr(TS).alias("start_at"), F.col("value").alias("seconds")).withColumnRenamed("event_id", "cue_id")
    s = S.batch_cue_sessions(c, 3600, F.date_trunc("day", F.col("start_at")))
    return ints(s.select("key", "session_no", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n_cues"))


@query("live_daily_status", "S4", sql("""
    select strftime(ts, '%Y-%m-%d') as day, case when status='error' then 'error' when status='done' then 'completed' else 'active' end category, count(*) n from progress
    group by all""", "progress"))
def live_daily_status(spark, d):
    return S.daily_status(runs(events(spark, d)))


@query("live_intake", "S5 SRC3", """
    select doc_id, cast(length(trim(text)) as bigint) chars from documents where length(trim(text)) >= 2 and not regexp_full_match(trim(text), '[\\d\\s.,;:+*/=%$€£¥()\\[\\]{}-]+')""")
def live_intake(spark, d):
    f = S.source(spark, d, "documents").select("doc_id", "text")
    b = S.intake(f, P.txt_blocks)
    return ints(b.groupBy("doc_id").agg(F.sum(F.length("source_text")).alias("chars")))


@query("live_unique_requests", "S6", "select distinct user_id || event_type request_key from events")
def live_unique_requests(spark, d):
    e = events(spark, d).select(F.concat("user_id", "event_type").alias("request_key"))
    return S.unique_requests(e)

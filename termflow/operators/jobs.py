"""Analytics over jobs and their language runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import labels as L
from ..functions import text as T
from ..skew import global_rank, lag_by_chunk, running_sum_by_chunk, salted_join


def fan_out(requests: DataFrame, languages: str) -> DataFrame:
    """One row per requested language of a comma list; blanks drop out."""
    wanted = F.filter(F.transform(F.split(languages, ","), T.strip), lambda x: x != "")
    return requests.withColumn("target_lang", F.explode(wanted)).drop(languages)


def fan_out_jobs(jobs: DataFrame, languages: list[str]) -> DataFrame:
    return jobs.withColumn("target_lang", F.explode(F.array(*[F.lit(x) for x in languages])))


def review_enabled(lang: Column, enabled: list[str] | None) -> Column:
    return F.lit(True) if enabled is None else F.lower(lang).isin([x.lower() for x in enabled])


def text_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """First known source language, total time and number of filled translations."""
    return results.groupBy(*keys).agg(
        F.min_by("source_lang", F.when(F.col("source_lang") != "", F.col("pos"))).alias("source_lang"),
        F.sum("elapsed").alias("elapsed"), F.count_if(F.col("translated") != "").alias("succeeded"))


def rollup_runs(runs: DataFrame, order: list[str]) -> DataFrame:
    """State of every job from its runs.

    The three languages shown come from a top-three per job, which keeps at most three rows per
    task and job before any shuffle.
    """
    s = F.col("status")
    active = s.isin(K.ACTIVE_RUN_STATUSES)
    pct = F.when(s.isin(K.TERMINAL_STATUSES), 100).otherwise(F.greatest(F.lit(0), L.run_percent(
        F.col("segments_done"), F.col("segments_total"), s == "reviewing")))
    sums = runs.groupBy("job_id").agg(
        F.count("*").alias("n_runs"), F.count_if(s == "done").alias("n_done"), F.count_if(s == "error").alias("n_error"),
        F.count_if(s.isin(K.TERMINAL_STATUSES)).alias("n_terminal"), F.count_if(active).alias("n_active"),
        F.sum("segments_done").alias("segments_done"), F.sum("segments_total").alias("segments_total"), F.sum(pct).alias("pct_sum"),
        F.bool_or(s == "rebuilding").alias("rebuilding"), F.bool_or(s == "reviewing").alias("reviewing"))
    top = (runs.where(active).select("job_id", "target_lang", *order).withColumn(
        "r", F.row_number().over(Window.partitionBy("job_id").orderBy(*order))).where("r <= 3")
        .groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "target_lang"))),
                                                        lambda x: x["target_lang"]), ", ").alias("shown")))
    j = sums.join(top, "job_id", "left")
    more = F.when(F.col("n_active") > 3, F.concat(F.lit(" +"), F.col("n_active") - 3)).otherwise("")
    return j.select(
        "job_id", "n_runs", "n_done", "n_error", "n_terminal", "segments_done", "segments_total",
        F.least(F.lit(99), 15 + F.floor(F.col("pct_sum") * 84 / (F.col("n_runs") * 100))).cast("bigint").alias("percent"),
        F.when(F.col("rebuilding"), "rebuilding").when(F.col("reviewing"), "reviewing").when(F.col("n_active") > 0, "translating")
        .when(F.col("n_terminal") == F.col("n_runs"), "done").otherwise("translating").alias("status"),
        F.concat(F.coalesce("shown", F.lit("")), more).alias("current_range"))


def outcomes(rollup: DataFrame) -> DataFrame:
    """Final result of a job: complete, partial or failed."""
    d, e = F.col("n_done"), F.col("n_error")
    return rollup.select("job_id", F.when((d > 0) & (e == 0), "complete").when(d > 0, "partial").otherwise("failed").alias("outcome"),
                         F.when(d > 0, "done").otherwise("error").alias("final_status"), "n_done", "n_error")


def with_labels(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Category, extension and time bucket. Grouping and sorting read the times in different order."""
    cat = L.status_category(F.col("status"))
    bucket = L.time_bucket(F.coalesce("created_at", "completed_at", "started_at"), as_of)
    return (jobs.withColumn("category", cat).withColumn("category_order", L.category_order(cat))
            .withColumn("extension", T.file_extension(F.col("filename")))
            .withColumn("bucket", bucket).withColumn("bucket_order", L.bucket_order(bucket))
            .withColumn("sort_time", F.coalesce("created_at", "started_at", "completed_at")))


def filter_jobs(labelled: DataFrame, search: str = "", categories=(), extensions=(), buckets=()) -> DataFrame:
    out = labelled
    if search:
        out = out.where(F.contains(F.lower("filename"), F.lit(search.lower())))
    for column, wanted in (("category", categories), ("extension", extensions), ("bucket", buckets)):
        if wanted:
            out = out.where(F.col(column).isin(list(wanted)))
    return out


def group_counts(labelled: DataFrame, primary: str, secondary: str) -> DataFrame:
    """Counts of both levels; the total of a primary group has a null secondary value."""
    return (labelled.rollup(primary, secondary).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
            .where("g < 3").select(primary, secondary, "n"))


def newest_first(labelled: DataFrame) -> DataFrame:
    """All jobs with their place, newest first."""
    return global_rank(labelled, [F.col("sort_time").desc_nulls_last(), F.col("job_id")])


def listing(labelled: DataFrame) -> DataFrame:
    """All jobs with their place: active, failed, finished; newest first inside each."""
    return global_rank(labelled, [F.col("category_order"), F.col("sort_time").desc_nulls_last(), F.col("job_id")])


def file_types(labelled: DataFrame) -> DataFrame:
    return labelled.where("extension <> ''").select("extension").distinct().orderBy("extension")


def live_over_history(live: DataFrame, history: DataFrame) -> DataFrame:
    return live.unionByName(history.join(live.select("job_id"), "job_id", "left_anti"), allowMissingColumns=True)


def save_jobs(stored: DataFrame, changed: DataFrame) -> DataFrame:
    """Insert or overwrite whole rows by id."""
    return changed.unionByName(stored.join(changed.select("job_id"), "job_id", "left_anti"))


def delete_jobs(jobs: DataFrame, outputs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove jobs and the outputs stored under their prefix."""
    gone = ids.select(F.col("job_id").cast("string").alias("_id")).distinct()
    owner = F.regexp_extract("path", r"^jobs/([^/]+)/", 1)
    return (jobs.join(gone, F.col("job_id").cast("string") == F.col("_id"), "left_anti"),
            outputs.withColumn("_owner", owner).join(gone, F.col("_owner") == F.col("_id"), "left_anti").drop("_owner"))


def outputs(runs: DataFrame) -> DataFrame:
    """Stored files of finished runs from their download links."""
    links = runs.where("status = 'done'").select("job_id", F.explode(F.array("download_url", "draft_download_url")).alias("url"))
    name = F.regexp_extract("url", r"^/api/download/([^/]+)/(.+)$", 2)
    mine = F.regexp_extract("url", r"^/api/download/([^/]+)/(.+)$", 1) == F.col("job_id").cast("string")
    return (links.where(mine & (name != "")).select("job_id", name.alias("filename"))
            .withColumn("path", F.concat(F.lit("jobs/"), "job_id", F.lit("/output/"), "filename")))


def top_rows_per_job(rows: DataFrame, order: list[Column], n: int = 20) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("job_id").orderBy(*order))).where(F.col("rank") <= n)


def phase_funnel(jobs: DataFrame) -> DataFrame:
    s = F.col("status")
    phases = F.array(
        F.when(F.col("use_glossary"), F.struct(F.lit("glossary").alias("phase"), L.glossary_phase(s).alias("state"))),
        F.struct(F.lit("translation").alias("phase"), L.translation_phase(s).alias("state")))
    return (jobs.select(F.explode(phases).alias("p")).where("p is not null").groupBy("p.phase", "p.state")
            .agg(F.count("*").alias("n")))


STEPS = {"extract": (["parsing", "terminology"], True), "confirm": (["awaiting_glossary_review"], True),
         "translate": (["translating", "rebuilding"], False), "review": (["reviewing"], False)}


def step_funnel(jobs: DataFrame) -> DataFrame:
    s, g = F.col("status"), F.col("use_glossary")
    steps = [F.when(g | F.lit(not only_glossary), F.struct(
        F.lit(name).alias("step"), F.when(g, L.step_state(s, active, True)).otherwise(
            L.step_state(s, active, False) if not only_glossary else F.lit(None)).alias("state")))
        for name, (active, only_glossary) in STEPS.items()]
    steps.append(F.struct(F.lit("complete").alias("step"), F.when(s == "done", "done").otherwise("pending").alias("state")))
    return jobs.select(F.explode(F.array(*steps)).alias("p")).where("p is not null").groupBy("p.step", "p.state").agg(F.count("*").alias("n"))


def stage_timing(progress: DataFrame, total: Column, chunk: Column) -> DataFrame:
    """Timing after every progress row: (run_id, event_id, elapsed, per_segment, eta).

    A change of status restarts the clock; the first row of a stage has no estimate. One run may
    own a large share of the rows, so stages are found chunk by chunk.
    """
    order = ["ts", "event_id"]
    lagged = lag_by_chunk(progress, ["run_id"], order, chunk, F.col("status"), "_prev")
    terminal = F.col("status").isin(K.TERMINAL_STATUSES)
    starts = lagged.withColumn("_new", (~terminal & ~F.col("status").eqNullSafe(F.col("_prev"))).cast("int"))
    staged = running_sum_by_chunk(starts, ["run_id"], order, chunk, F.col("_new"), "_stage")
    begun = staged.groupBy("run_id", "_stage").agg(F.min(F.when(F.col("_new") == 1, F.col("ts"))).alias("_start"))
    j = salted_join(staged, begun, ["run_id", "_stage"], ["event_id"])
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    elapsed = F.when(F.col("_start").isNotNull(), (micros(F.col("ts")) - micros(F.col("_start"))) / 1e6)
    timed = F.col("status").isin("translating", "reviewing") & (F.col("segments_done") > 0) & (total > 0) & (F.col("_new") == 0)
    per = F.when(timed & ~terminal, elapsed / F.col("segments_done"))
    return j.select("run_id", "event_id", "status", elapsed.alias("elapsed"), per.alias("per_segment"),
                    F.when(F.col("status") == "done", 0.0).when(timed & ~terminal, F.greatest(
                        F.lit(0), total - F.col("segments_done")) * per).alias("eta"))


def versions(contents: DataFrame, chunk: Column) -> DataFrame:
    """Version history: a row is a new version when its hash differs from the row before.

    contents: name, ts, event_id, hash."""
    order = ["ts", "event_id"]
    lagged = lag_by_chunk(contents, ["name"], order, chunk, F.col("hash"), "_prev")
    new = lagged.where(~F.col("hash").eqNullSafe(F.col("_prev")))
    numbered = running_sum_by_chunk(new, ["name"], order, chunk, F.lit(1), "version_no")
    return numbered.select("name", "ts", "event_id", "hash", F.col("version_no").cast("bigint").alias("version_no"),
                           F.concat("name", F.lit("_v"), F.col("version_no").cast("string")).alias("version_id"))


def latest_versions(history: DataFrame, scores: DataFrame) -> DataFrame:
    """Newest version per name with its scores (name, test_id, score); a repeated test keeps the last."""
    top = history.groupBy("name").agg(F.max_by(F.struct("version_id", "hash"), "version_no").alias("v")).select("name", "v.*")
    last = scores.groupBy("name", "test_id").agg(F.max_by("score", "event_id").alias("score"))
    m = last.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("test_id", "score"))).alias("scores"))
    return top.join(m, "name", "left")

"""Display and status expressions over jobs and runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def status_category(s: Column) -> Column:
    return F.when(s == "error", "error").when(s.isin("done", "cancelled"), "completed").otherwise("active")


def category_order(cat: Column) -> Column:
    return F.when(cat == "active", 0).when(cat == "error", 1).when(cat == "completed", 2).otherwise(9)


def time_bucket(ts: Column, as_of: Column) -> Column:
    today = F.date_trunc("day", as_of)
    back = lambda n: today - F.expr(f"interval {n} day")
    return (F.when(ts.isNull(), "unknown").when(ts >= today, "today")
            .when(ts >= back(1), "yesterday").when(ts >= back(7), "last7Days")
            .when(ts >= back(30), "last30Days").otherwise("older"))


def bucket_order(bucket: Column) -> Column:
    return (F.when(bucket == "today", 0).when(bucket == "yesterday", 1).when(bucket == "last7Days", 2)
            .when(bucket == "last30Days", 3).when(bucket == "older", 4).otherwise(99))


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("bigint")


def duration_text(sec: Column) -> Column:
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    return (F.when(sec.isNull() | (sec < 0) | F.isnan(sec) | (sec == float("inf")), "")
            .when(sec < 1, "<1s")
            .when(sec < 60, F.concat(half_up(sec).cast("string"), F.lit("s")))
            .when(sec < 3600, F.concat(F.floor(sec / 60).cast("string"), F.lit("m"),
                                       pad(half_up(sec % 60)), F.lit("s")))
            .otherwise(F.concat(F.floor(sec / 3600).cast("string"), F.lit("h"),
                                pad(half_up((sec % 3600) / 60)), F.lit("m"))))


def run_percent(done: Column, total: Column, reviewing: Column) -> Column:
    part = F.floor(done / total * 50)
    return (F.when((total <= 0) & reviewing, 50).when(total <= 0, 0)
            .when(reviewing, F.least(F.lit(99), 50 + part))
            .otherwise(F.least(F.lit(50), part))).cast("bigint")


def phase_state(status: Column, active: list[str], done: list[str]) -> Column:
    return F.when(status.isin(active), "active").when(status.isin(done), "done").otherwise("pending")


def glossary_phase(status: Column) -> Column:
    return phase_state(status, ["parsing", "terminology", "awaiting_glossary_review"],
                       ["translating", "rebuilding", "reviewing", "done"])


def translation_phase(status: Column) -> Column:
    return phase_state(status, ["translating", "rebuilding"], ["reviewing", "done"])


def step_state(status: Column, active: list[str], with_glossary: bool) -> Column:
    """Progress of one step; a status outside the chain (failed, cancelled) leaves it pending."""
    chain = (["queued", "pending", "parsing", "terminology", "awaiting_glossary_review"]
             if with_glossary else ["queued", "pending"]) + ["translating", "rebuilding", "reviewing", "done"]
    after = chain[max(chain.index(a) for a in active) + 1:]
    return phase_state(status, active, after)


def status_ordinal(s: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in K.STATUSES]), s).cast("bigint")

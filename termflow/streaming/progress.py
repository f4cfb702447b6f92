"""Streaming twins of the progress, session and intake jobs.

Each run processes what is available and stops; the same queries run continuously with another trigger.
What must be remembered between micro-batches by key is in Spark's state store, under the checkpoint of
the query, so a run that starts again with the same folder goes on where the last one ended. Results
are kept in two ways: as versions, one folder per batch, of which a reader takes the last of each key,
or as tables in buckets (termflow.tables), of which a batch changes only those that it touches. A
repeated batch changes neither.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import constants as K
from ..functions import labels as L
from ..session import new_path
from ..skew import lag_by_chunk, running_sum_by_chunk
from ..tables import BUCKETS, BucketTable, latest_wins

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 24 * 3600 * 1000


def source(spark: SparkSession, sf_dir: str, table: str, files_per_batch: int = 100) -> DataFrame:
    """A table as a stream, one file or a folder of part files; files are taken as they appear. A stream
    wants a folder or a pattern, so the name is given as a pattern that only fits itself."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


@contextlib.contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """State variables by key need the RocksDB store. Timers of processing time ask for batches without
    data for ever, so a drained run goes without those; timers fire with the next data. Both settings
    are read when a query starts."""
    wanted = {PROVIDER: ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def _drained(stream: DataFrame, folder: str, mode: str, each) -> None:
    """Run a stream over what is available; `each` gets every batch with its number."""
    with _settings(stream.sparkSession):
        (stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state")
         .foreachBatch(each).start().awaitTermination())


def _written(stream: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """All rows that a query emits, with the number of their batch; no row for an empty stream."""
    spark = stream.sparkSession
    folder = folder or new_path(spark, name)
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/out/batch=-1")
    _drained(stream, folder, mode, lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"))
    return spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/out")


def _last(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last version of every key."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_v")).select(*keys, "_v.*")


def _kinds(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in names)


def latest_runs(events: DataFrame, folder: str | None = None) -> DataFrame:
    """Newest event of every run over a stream of (run_id, job_id, ts, event_id, ...)."""
    cols = events.columns
    rest = [c for c in cols if c != "run_id"]
    newest = (events.groupBy("run_id").agg(F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("e"))
              .select("run_id", "e.*").select(cols))
    return _last(_written(newest, "latest-runs", "update", folder), ["run_id"]).select(cols)


#: What a run adds to its job; every one is a sum, so it can be taken back.
PARTS = ("n_runs", "n_done", "n_error", "n_terminal", "n_active", "n_rebuilding", "n_reviewing", "segments_done", "segments_total", "pct_sum")


def _parts(status: Column) -> list[Column]:
    of = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    done, total = F.col("segments_done"), F.col("segments_total")
    terminal = status.isin(K.TERMINAL_STATUSES)
    pct = F.when(terminal, 100).otherwise(F.greatest(F.lit(0), L.run_percent(done, total, status == "reviewing")))
    values = [F.lit(1), of(status == "done"), of(status == "error"), of(terminal), of(status.isin(K.ACTIVE_RUN_STATUSES)),
              of(status == "rebuilding"), of(status == "reviewing"), F.coalesce(done, F.lit(0)), F.coalesce(total, F.lit(0)),
              F.coalesce(pct, F.lit(0))]
    return [v.cast("long").alias(name) for name, v in zip(PARTS, values, strict=True)]


class Retraction(StatefulProcessor):
    """Newest event of a run: when a newer one comes, what the one before added is taken back."""

    def init(self, handle) -> None:
        self.newest = handle.getValueState("newest", "at long, event_id long, job_id long, " + ", ".join(f"{p} long" for p in PARTS))

    def handleInputRows(self, key, rows, timerValues):
        top = None
        for frame in rows:
            best = frame.sort_values(["at", "event_id"], kind="stable").iloc[-1]
            row = tuple(int(best[c]) for c in ("at", "event_id", "job_id", *PARTS))
            top = row if top is None or row[:2] > top[:2] else top
        before = self.newest.get() if self.newest.exists() else None
        if before is None or top[:2] > tuple(before)[:2]:
            self.newest.update(top)
            changes = [(top[2], *top[3:])] + ([(before[2], *[-x for x in before[3:]])] if before is not None else [])
            yield pd.DataFrame(changes, columns=["job_id", *PARTS])

    def close(self) -> None:
        pass


def _added(keys: list[str], parts: tuple[str, ...]):
    """Merge of sums: the changes are added to what is stored."""
    return lambda old, changes: old.unionByName(changes).groupBy(*keys).agg(*[F.sum(p).alias(p) for p in parts])


def live_rollup(events: DataFrame, folder: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Job state from the newest event of every run, by retraction.

    A run's newest event is keyed state. A newer one emits what it adds to its job and takes back what
    its predecessor added, even from another job; the changes of a batch are summed by job and added
    to the totals in their buckets. So a batch costs what it changes; nothing is aggregated again.
    Events without a run, time or job are left out; one that is older than its run's newest changes
    nothing. The languages that `rollup_runs` shows need the runs themselves and are not here.
    """
    spark = events.sparkSession
    folder = folder or new_path(spark, "rollup")
    rows = events.where("run_id is not null and ts is not null and job_id is not null").select(
        "run_id", F.unix_micros("ts").alias("at"), F.col("event_id").cast("long").alias("event_id"),
        F.col("job_id").cast("long").alias("job_id"), *_parts(F.col("status")))
    changes = rows.groupBy("run_id").transformWithStateInPandas(
        Retraction(), "job_id long, " + ", ".join(f"{p} long" for p in PARTS), "append", "none")
    totals = BucketTable(spark, f"{folder}/totals", changes.schema, ["job_id"], buckets)
    sums = _added(["job_id"], PARTS)
    _drained(changes, folder, "append", lambda df, n: totals.update(
        df.groupBy("job_id").agg(*[F.sum(p).alias(p) for p in PARTS]), sums, f"batch-{n}"))
    active = F.when(F.col("n_rebuilding") > 0, "rebuilding").when(F.col("n_reviewing") > 0, "reviewing").when(F.col("n_active") > 0, "translating")
    return totals.read().where("n_runs > 0").select(
        "job_id", "n_runs", "n_done", "n_error", "n_terminal", "segments_done", "segments_total",
        F.least(F.lit(99), 15 + F.floor(F.col("pct_sum") * 84 / (F.col("n_runs") * 100))).cast("bigint").alias("percent"),
        active.when(F.col("n_terminal") == F.col("n_runs"), "done").otherwise("translating").alias("status"))


class StageTiming(StatefulProcessor):
    """Events of a run in time order, and what was before the first of them.

    An event that comes late takes its place, and it and all later events are told again. A timer
    that each batch of a run sets anew forgets a run after `idle_ms`: all of a finished one; of
    another its events, but not the status and the start of the stage it is in.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.events = handle.getValueState("events", "at array<long>, event_id array<long>, status array<string>, done array<long>, total array<long>")
        self.before = handle.getValueState("before", "at long, event_id long, status string, start long")

    def _held(self) -> dict:
        """The events of a run, which are one value: a call to the state costs more than what it carries."""
        packed = self.events.get()
        return {} if packed is None else {(at, event): rest for at, event, *rest in zip(*packed, strict=True)}

    def handleInputRows(self, key, rows, timerValues):
        before = self.before.get()
        held = self._held()
        new, lost = {}, []
        for frame in rows:
            number = lambda c: [None if v is None or v != v else int(v) for v in frame[c].tolist()]
            status_of = [v if isinstance(v, str) else None for v in frame["status"].tolist()]
            for at, event, status, done, total in zip(frame["at"].tolist(), number("event_id"), status_of, number("segments_done"), number("total"), strict=True):
                if before is not None and (at, event) <= (before[0], before[1]):
                    lost.append((key[0], event, status, None, None, 0.0 if status == "done" else None))
                else:
                    new[(at, event)] = (status, done, total)
        out = lost
        if new:
            events = {**held, **new}
            self.events.update(tuple(map(list, zip(*[(*place, *rest) for place, rest in events.items()], strict=True))))
            out = lost + self._told(key[0], events, before, min(new))[0]
        if held or before is not None:  # else the run has no timer yet
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if out:
            yield pd.DataFrame(out, columns=["run_id", "event_id", "status", "elapsed", "per_segment", "eta"]).astype(
                {"elapsed": "float64", "per_segment": "float64", "eta": "float64"})

    @staticmethod
    def _told(run, events, before, since):
        """Rows from `since` on, the last status and the start of its stage."""
        status_before, start = (before[2], before[3]) if before is not None else (None, None)
        out = []
        for place in sorted(events):
            status, done, total = events[place]
            final = status in K.TERMINAL_STATUSES
            new = not final and status != status_before
            start = place[0] if new else start
            elapsed = None if start is None else (place[0] - start) / 1e6
            working = status in ("translating", "reviewing") and (done or 0) > 0 and (total or 0) > 0
            per = elapsed / done if elapsed is not None and working and not new else None
            eta = 0.0 if status == "done" else None if per is None else max(0, total - done) * per
            if place >= since:
                out.append((run, place[1], status, elapsed, per, eta))
            status_before = status
        return out, status_before, start

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        events = self._held()
        before = self.before.get()
        if events:
            last = max(events)
            _, status, start = self._told(key[0], events, before, last)
            self.events.clear()
            if status in K.TERMINAL_STATUSES:
                self.before.clear()
            else:
                self.before.update((*last, status, start))
        elif before is not None and before[2] in K.TERMINAL_STATUSES:
            self.before.clear()
        return iter([])

    def close(self) -> None:
        pass


def live_timing(events: DataFrame, total: Column, folder: str | None = None, idle_ms: int = DAY_MS) -> DataFrame:
    """Stage timing of every event as it arrives, whatever the order of the files.

    A late event changes the timing of those after it, which are written again as versions; a reader
    takes the last. A run that is silent for `idle_ms` of processing time is forgotten (see
    StageTiming); an event that then comes for a time before it is told without timing. Events
    without a run or time are left out. stage_timing() is the form for stored events.
    """
    rows = events.where("run_id is not null and ts is not null").select(
        "run_id", F.unix_micros("ts").alias("at"), F.col("event_id").cast("long").alias("event_id"), "status",
        F.col("segments_done").cast("long").alias("segments_done"), total.cast("long").alias("total"))
    schema = f"{_kinds(rows, ['run_id', 'event_id', 'status'])}, elapsed double, per_segment double, eta double"
    timed = rows.groupBy("run_id").transformWithStateInPandas(StageTiming(idle_ms), schema, "append", "processingTime")
    return _last(_written(timed, "timing", "append", folder), ["run_id", "event_id"])


class CueSessions(StatefulProcessor):
    """Sessions of a key as intervals that do not touch, by start; a cue joins those it touches. They are one value, as
    a call to the state costs more than what it carries; each is dropped `idle_ms` after its last change. A session is
    known by its start and the time of the batch that it was born in, so one that the state has forgotten
    is not taken for a new one with the same start."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.open = handle.getValueState("open", ", ".join(f"{c} array<long>" for c in ("start", "until", "n", "born", "touched")), self.idle_ms)

    def handleInputRows(self, key, rows, timerValues):
        fresh: list[tuple[int, int, int]] = []
        for frame in rows:
            cues = sorted(zip(frame["start"].tolist(), frame["until"].tolist(), [1] * len(frame), strict=True))
            fresh = merged_intervals(sorted(fresh + cues))
        packed, time = self.open.get(), timerValues.getCurrentProcessingTimeInMs()
        held = {s: rest for s, *rest in zip(*packed, strict=True) if rest[3] + self.idle_ms > time} if packed is not None else {}
        now = {s: (u, n) for s, u, n in merged_intervals(sorted([*((s, u, n) for s, (u, n, *_) in held.items()), *fresh]))}
        out = []
        for start in held.keys() - now.keys():
            out.append((start, held[start][2], held[start][0], 0))
        kept = []
        for start, session in now.items():
            born, touched = held[start][2:] if start in held else (time, time)
            if start not in held or tuple(held[start][:2]) != session:
                touched = time
                out.append((start, born, *session))
            kept.append((start, *session, born, touched))
        self.open.update(tuple(map(list, zip(*kept, strict=True))))
        yield pd.DataFrame([(key[0], *s) for s in out], columns=["key", "start", "born", "until", "n_cues"])

    def close(self) -> None:
        pass


def merged_intervals(ordered: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Intervals (start, until, n) in order of their start, joined where they touch."""
    out: list[tuple[int, int, int]] = []
    for start, until, n in ordered:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], until), out[-1][2] + n)
        else:
            out.append((start, until, n))
    return out


def cue_sessions(cues: DataFrame, gap_seconds: float, idle_ms: int = DAY_MS, folder: str | None = None) -> DataFrame:
    """(key, session_start, session_end, n_cues) of a stream of (key, start_at, seconds): all sessions,
    open ones too; a pause of exactly the gap stays inside, session_end includes the gap.

    A key's sessions are one value of its state. A cue extends or joins the sessions it touches,
    however late it is; every change is emitted as a version, and a start that is joined to another with
    no cues. A session that nothing touched for `idle_ms` of processing time leaves the state; a cue that
    touches it later makes a session of its own, which the reader joins to it. So the result is that of
    all cues in any order, and the state holds what is in use. Cues without a start are left out, without
    a length they have none.
    """
    start = F.unix_micros("start_at")
    length = F.round((F.coalesce("seconds", F.lit(0.0)) + gap_seconds) * 1e6).cast("long")
    rows = cues.where("start_at is not null").select("key", start.alias("start"), (start + length).alias("until"))
    sessions = rows.groupBy("key").transformWithStateInPandas(
        CueSessions(idle_ms), f"{_kinds(rows, ['key'])}, start long, born long, until long, n_cues long", "append", "processingTime")
    last = _last(_written(sessions, "sessions", "append", folder), ["key", "start", "born"]).where("n_cues > 0")
    order = Window.partitionBy("key").orderBy("start", "born")
    apart = F.coalesce(F.col("start") > F.max("until").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    number = F.sum(F.col("_apart").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (last.withColumn("_apart", apart).withColumn("_k", number).groupBy("key", "_k")
            .agg(F.timestamp_micros(F.min("start")).alias("session_start"), F.timestamp_micros(F.max("until")).alias("session_end"),
                 F.sum("n_cues").alias("n_cues")).drop("_k"))


def batch_cue_sessions(cues: DataFrame, gap_seconds: float, chunk: Column) -> DataFrame:
    """Sessions offline, against the end of the cue before, chunk by chunk."""
    order = ["start_at", "cue_id"]
    end = F.col("start_at") + F.make_dt_interval(secs=F.col("seconds").cast("decimal(18,6)"))
    j = lag_by_chunk(cues, ["key"], order, chunk, end, "before")
    new = F.when(F.col("before").isNull() | (F.col("start_at") > F.col("before") + F.make_dt_interval(secs=F.lit(gap_seconds).cast("decimal(18,6)"))), 1).otherwise(0)
    n = running_sum_by_chunk(j.withColumn("_new", new), ["key"], order, chunk, F.col("_new"), "session_no")
    return n.groupBy("key", "session_no").agg(F.min("start_at").alias("session_start"), F.count("*").alias("n_cues"))


def daily_status(events: DataFrame, folder: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Events per day and status category, in any order of arrival. A batch counts its own events and adds
    them to the days they fall on; nothing is kept in a state. Events without a time have a null day."""
    spark = events.sparkSession
    folder = folder or new_path(spark, "daily-status")
    rows = events.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), L.status_category(F.col("status")).alias("category"), F.lit(1).cast("long").alias("n"))
    counts = BucketTable(spark, f"{folder}/counts", rows.schema, ["day"], buckets)
    add = _added(["day", "category"], ("n",))
    _drained(rows, folder, "append", lambda df, n: counts.update(df.groupBy("day", "category").agg(F.sum("n").alias("n")), add, f"batch-{n}"))
    return counts.read()


def intake(files: DataFrame, to_blocks, folder: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Blocks of arriving (doc_id, text) files; a file that comes again replaces its blocks.

    Blocks lie in buckets by their document. A batch reads the buckets of its documents, replaces their
    blocks and leaves all other buckets as they are; a reader finds one version of a document. A document
    without blocks keeps a mark, so that what it had before goes. Of several texts of a document in one
    batch the greatest counts; files without an id are left out.
    """
    spark = files.sparkSession
    folder = folder or new_path(spark, "intake")

    def work(df):
        once = df.where("doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("text"))
        return once.select("doc_id").join(to_blocks(once).withColumn("is_block", F.lit(True)), "doc_id", "left")
    schema = work(spark.createDataFrame([], files.schema)).schema
    blocks = BucketTable(spark, f"{folder}/blocks", schema, ["doc_id"], buckets)
    _drained(files, folder, "append", lambda df, n: blocks.update(work(df), lambda old, new: latest_wins(old, new, ["doc_id"]), f"batch-{n}"))
    return blocks.read().where("is_block").drop("is_block")


def unique_requests(events: DataFrame, remember: str = "1 hour", folder: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """One row per request key, over restarts and files in any order.

    Spark's state remembers the keys of the last `remember` of processing time, which takes away most
    repetitions; its size follows the recent traffic. What passes is looked up in a table of all keys, in
    buckets by key, and only new keys are added. A null key is a key of its own.
    """
    spark = events.sparkSession
    folder = folder or new_path(spark, "requests")
    recent = (events.select("request_key", F.current_timestamp().alias("_now")).withWatermark("_now", remember)
              .dropDuplicatesWithinWatermark(["request_key"]).select("request_key"))
    known = BucketTable(spark, f"{folder}/keys", recent.schema, ["request_key"], buckets)
    _drained(recent, folder, "append", lambda df, n: known.update(df, lambda old, new: old.union(new).distinct(), f"batch-{n}"))
    return known.read()

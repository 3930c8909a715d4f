"""The progress log as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.events import HEARTBEAT_SECONDS, JOB_TTL_SECONDS, TERMINAL, fold_aggregates, state_of
from ..operators.ordering import with_previous
from ..session import checkpointed
from ..sources.commits import Buckets

EVENT_SCHEMA = (
    "job_id string, seq long, ts timestamp, type string, state string, failed boolean, "
    "index long, total long, new_chapters long"
)


#: The default JSON form of a time stamp would cut it to milliseconds.
_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def write_log(events: DataFrame, path: str) -> None:
    """Append events as JSON lines."""
    events.write.mode("append").options(**_TIME).json(path)


def read_log(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).options(**_TIME).json(path)


def follow_log(spark: SparkSession, path: str, files_per_batch: int = 100, schema: str = EVENT_SCHEMA) -> DataFrame:
    """Full history first, then live; the query's checkpoint keeps the place."""
    return (
        spark.readStream.schema(schema).options(**_TIME).option("maxFilesPerTrigger", files_per_batch).json(path)
    )


def deliver_once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Drop repeated (job_id, seq) deliveries; the watermark bounds what is remembered."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["job_id", "seq"])


def streaming_job_states(events: DataFrame) -> DataFrame:
    """Running fold of job states (update or complete mode).

    Built-in aggregates combine map-side, so a job that emits a third of all
    events sends one row per task and batch to its state.
    """
    folded = events.groupBy("job_id").agg(*fold_aggregates())
    return folded.withColumn("state", state_of(F.col("ended"), F.col("control"), F.col("stop_requested")))


EXPIRY_SCHEMA = "job_id string, phase string, finished_us long, late boolean"


class _Retention(StatefulProcessor):
    """A job's first end is held until its event-time timer, ``ttl`` seconds later, fires."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.finished = handle.getValueState("finished", "us long")

    def _row(self, key: tuple, phase: str, us: int, late: bool) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]], "phase": [phase], "finished_us": [us], "late": [late]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = min(int(b["us"].min()) for b in rows)
        held = self.finished.get()[0] if self.finished.exists() else None
        if held is not None and held <= first:
            return
        clock, due = timerValues.getCurrentWatermarkInMs(), first // 1000 + self.ttl * 1000
        if held is None:
            # An end older than the clock is told apart, not lost: its retention counts all the same.
            yield self._row(key, "finished", first, first // 1000 < clock)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if due <= clock:
            self.finished.clear()
            yield self._row(key, "expired", first, False)
            return
        self.finished.update((first,))
        self.handle.registerTimer(due)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        us = self.finished.get()[0]
        self.finished.clear()
        yield self._row(key, "expired", us, False)

    def close(self) -> None:
        pass


def expiring_jobs(events: DataFrame, ttl: int = JOB_TTL_SECONDS, late: str = "10 minutes") -> DataFrame:
    """Finished jobs, once when they finish and once when their retention ends.

    Only terminal events reach the keyed state: a job has one or two of them, so no key is hot here, and an
    event-time timer clears the state. The clock is the newest end seen less ``late``. An end behind the clock is a row with
    ``late`` set, and expires like any other; see ``rejected``. The state store must be RocksDB, see ``with_rocksdb``.
    """
    ends = events.filter(F.col("type").isin(*TERMINAL)).withWatermark("ts", late)
    # The time goes on as a plain number: a column with a watermark would let Spark drop what is behind it.
    keyed = ends.select("job_id", F.unix_micros("ts").alias("us")).groupBy("job_id")
    return keyed.transformWithStateInPandas(_Retention(ttl), EXPIRY_SCHEMA, "append", "eventTime")


def rejected(phases: DataFrame) -> DataFrame:
    """Ends that came behind the clock."""
    return phases.filter("late")


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def active_spans(events: DataFrame, beat: int = HEARTBEAT_SECONDS, late: str = "10 minutes") -> DataFrame:
    """Spans of a job without ``beat`` seconds of silence: job_id, begin, last, events. Spans follow the clock, like all windows."""
    session = F.session_window("ts", f"{beat} seconds")
    return (
        events.withWatermark("ts", late).groupBy("job_id", session.alias("s"))
        .agg(F.min("ts").alias("begin"), F.max("ts").alias("last"), F.count("*").alias("events"))
        .select("job_id", "begin", "last", "events")
    )


def silences(spans: DataFrame, beat: int = HEARTBEAT_SECONDS) -> DataFrame:
    """Silent intervals between the spans of a job: job_id, from, until, beats."""
    prior = with_previous(spans, ["job_id"], ["begin"], {"from": "last"}).filter("`from` is not null")
    gap = F.unix_micros("begin") - F.unix_micros("from")
    return prior.select("job_id", "from", F.col("begin").alias("until"), F.floor(gap / (beat * 1_000_000)).cast("long").alias("beats"))


#: Combinable columns of a job's fold, as kept in a bucketed table.
FOLD_SCHEMA = (
    "job_id string, first_end struct<seq:long,type:string,ts:timestamp>, "
    "last_control struct<seq:long,state:string>, stop_requested boolean, events long, newest timestamp, batch long"
)


def _fold(events: DataFrame, batch: int) -> DataFrame:
    terminal, control = F.col("type").isin(*TERMINAL), F.col("type") == "status"
    return events.groupBy("job_id").agg(
        F.min(F.when(terminal, F.struct("seq", "type", "ts"))).alias("first_end"),
        F.max(F.when(control, F.struct("seq", "state"))).alias("last_control"),
        F.coalesce(F.bool_or(control & (F.col("state") == "stopping")), F.lit(False)).alias("stop_requested"),
        F.max("seq").alias("events"),
        F.max("ts").alias("newest"),
    ).withColumn("batch", F.lit(batch).cast("long"))


def fold_into(table: Buckets, ttl: int | None = JOB_TTL_SECONDS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps job folds in a bucketed table.

    Each batch is folded per job, once, before it meets the stored rows of the buckets it touches. A batch that is
    repeated after a failure has a number that was committed, and changes nothing. Jobs past their retention, by the newest
    event time seen, are dropped from the buckets that are written; ``job_folds`` leaves the others out.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        known = table.state()
        if known[1].get("batch", -1) >= batch_id:
            return
        folded = checkpointed(_fold(batch, batch_id))
        newest = folded.agg(F.unix_micros(F.max("newest"))).first()[0]
        newest = max(x for x in (newest, known[1].get("facts", {}).get("newest"), 0) if x is not None)

        def fold(rows: DataFrame) -> DataFrame:
            merged = rows.groupBy("job_id").agg(
                F.min("first_end").alias("first_end"),
                F.max("last_control").alias("last_control"),
                F.bool_or("stop_requested").alias("stop_requested"),
                F.max("events").alias("events"),
                F.max("newest").alias("newest"),
                F.max("batch").alias("batch"),
            )
            return _within(merged, ttl, newest)

        table.merge(folded, fold, batch_id, {"newest": newest}, known)

    return merge


def _within(folds: DataFrame, ttl: int | None, newest: int | None) -> DataFrame:
    if ttl is None or newest is None:
        return folds
    return folds.filter(F.col("first_end").isNull() | (F.lit(newest) - F.unix_micros("first_end.ts") <= ttl * 1_000_000))


def job_folds(table: Buckets, ttl: int | None = JOB_TTL_SECONDS) -> DataFrame:
    """Stored folds with the ``state`` of each job, those past their retention left out."""
    newest = table.state()[1].get("facts", {}).get("newest")
    state = state_of(F.col("first_end.type"), F.col("last_control.state"), F.col("stop_requested"))
    return _within(table.read(), ttl, newest).withColumn("state", state)

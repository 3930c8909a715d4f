"""The progress log in batch: sequence, replay, job state, running counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordering import with_ordinal, with_previous, with_running

# ---- fixed values -------------------------------------------------------
TERMINAL = ("done", "error")
JOB_TTL_SECONDS = 1800
HEARTBEAT_SECONDS = 15
# -------------------------------------------------------------------------


def with_sequence(events: DataFrame, order: list[str]) -> DataFrame:
    """Number each job's events from 1 in arrival order."""
    return with_ordinal(events, ["job_id"], order, "seq")


def replay(events: DataFrame, start: int | Column) -> DataFrame:
    """Events from index ``start`` on (0 is the first)."""
    return events.filter(F.col("seq") > start)


def until_terminal(events: DataFrame) -> DataFrame:
    """Nothing after a job's first done or error is delivered."""
    ends = events.filter(F.col("type").isin(*TERMINAL)).groupBy("job_id").agg(F.min("seq").alias("_end"))
    return (
        events.join(ends, "job_id", "left")
        .filter(F.col("_end").isNull() | (F.col("seq") <= F.col("_end")))
        .drop("_end")
    )


def fold_aggregates() -> list[Column]:
    """Combinable pieces of a job's state: used by the batch and the streaming fold."""
    terminal = F.col("type").isin(*TERMINAL)
    control = F.col("type") == "status"
    return [
        F.min_by(F.when(terminal, F.col("type")), F.when(terminal, F.col("seq"))).alias("ended"),
        F.min(F.when(terminal, F.col("ts"))).alias("finished_at"),
        F.max_by(F.when(control, F.col("state")), F.when(control, F.col("seq"))).alias("control"),
        F.coalesce(F.bool_or(control & (F.col("state") == "stopping")), F.lit(False)).alias("stop_requested"),
        F.max("seq").alias("events"),
    ]


def state_of(ended: Column, control: Column, stop_requested: Column) -> Column:
    return (
        F.when(ended == "error", F.lit("error"))
        .when((ended == "done") & stop_requested, F.lit("stopped"))
        .when(ended == "done", F.lit("done"))
        .when(stop_requested, F.lit("stopping"))
        .otherwise(F.coalesce(control, F.lit("running")))
    )


def job_states(events: DataFrame) -> DataFrame:
    """State per job, folded map-side first: a busy job costs one row per task."""
    folded = events.groupBy("job_id").agg(*fold_aggregates())
    return folded.withColumn(
        "state", state_of(F.col("ended"), F.col("control"), F.col("stop_requested"))
    )


def active_job(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """The first unfinished job in creation order; ``scheduled`` tells who started it."""
    ended = events.filter(F.col("type").isin(*TERMINAL)).select("job_id").distinct()
    open_jobs = jobs.join(ended, "job_id", "left_anti")
    best = open_jobs.agg(F.min_by(F.struct("job_id", "trigger"), F.struct("created", "job_id")).alias("_j"))
    return best.filter("_j is not null").select("_j.*").withColumn("scheduled", F.col("trigger") != "manual")


def live_jobs(states: DataFrame, now: Column, ttl: int = JOB_TTL_SECONDS) -> DataFrame:
    """Jobs not yet dropped: unfinished ones, and finished ones within the retention."""
    age = F.unix_micros(now) - F.unix_micros("finished_at")
    return states.filter(F.col("finished_at").isNull() | (age <= ttl * 1_000_000))


def job_progress(events: DataFrame) -> DataFrame:
    """Position of the progress bar: the last event that sets it decides.

    Events carry ``index``, ``total`` and ``new_chapters``.
    """
    value = F.when(F.col("type") == "update_started", F.lit(0)).otherwise(F.col("index"))
    total = F.when(F.col("type") == "update_started", F.col("new_chapters")).otherwise(F.col("total"))
    moving = events.filter(F.col("type").isin("update_started", "bulk_progress", "chapter_downloaded"))
    last = moving.groupBy("job_id").agg(F.max_by(F.struct(value.alias("value"), total.alias("total")), "seq").alias("p"))
    return last.select("job_id", "p.value", F.greatest("p.total", F.lit(1)).alias("total"))


def download_running(events: DataFrame) -> DataFrame:
    """Chapters delivered and failed so far, on each download event.

    A failed chapter is delivered as a placeholder, so it counts in both.
    """
    downloads = events.filter(F.col("type") == "chapter_downloaded")
    return with_running(
        downloads,
        ["job_id"],
        ["seq"],
        {"delivered": F.lit(1).cast("long"), "failures": F.col("failed").cast("long")},
    )


def idle_gaps(events: DataFrame, beat: int = HEARTBEAT_SECONDS) -> DataFrame:
    """Silent intervals of ``beat`` seconds before each event of a job."""
    prior = with_previous(events, ["job_id"], ["seq"], {"_before": "ts"})
    gap = F.unix_micros("ts") - F.unix_micros("_before")
    return prior.withColumn(
        "beats", F.coalesce(F.floor(gap / (beat * 1_000_000)), F.lit(0)).cast("long")
    ).drop("_before")


def result_status(requests: DataFrame, states: DataFrame) -> DataFrame:
    """What asking for a job's result would meet.

    ``states`` may carry ``error_detail``, which is then shown for failed jobs.
    """
    if "error_detail" not in states.columns:
        states = states.withColumn("error_detail", F.lit(None).cast("string"))
    known = states.select("job_id", "state", "error_detail")
    return requests.join(known, "job_id", "left").withColumn(
        "result",
        F.when(F.col("state").isNull(), F.lit("unknown_job"))
        .when(F.col("state") == "error", F.coalesce(F.nullif("error_detail", F.lit("")), F.lit("job_failed")))
        .when(F.col("state").isin("done", "stopped"), F.lit("ready"))
        .otherwise(F.lit("job_still_running")),
    ).drop("error_detail")

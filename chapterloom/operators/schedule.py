"""Run log and schedule: newest runs, last real run, due tests, skip collapse.

Runs carry ``seq``, their place in the log: the log's order is append order,
not time order. Tables are keyed by ``library_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordering import top_k, with_running

# ---- fixed values -------------------------------------------------------
MAX_RUNS = 20
MIN_INTERVAL_HOURS = 1
DEFAULT_INTERVAL_HOURS = 24
STARTUP_DELAY_SECONDS = 30
# -------------------------------------------------------------------------


def newest_runs(runs: DataFrame, most: int = MAX_RUNS) -> DataFrame:
    """The newest runs of each library, newest first by ``rank``."""
    return top_k(runs, ["library_id"], [F.desc("seq")], most)


def last_real_runs(runs: DataFrame) -> DataFrame:
    """When each library was last checked; skipped passes do not count."""
    real = runs.filter(F.col("status") != "skipped")
    return real.groupBy("library_id").agg(F.max_by("finished_at", "seq").alias("last_run_at"))


def split_settings(settings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid settings, rejected ones): an interval is at least one hour."""
    ok = F.coalesce(F.col("interval_hours") >= MIN_INTERVAL_HOURS, F.lit(False))
    return settings.filter(ok), settings.filter(~ok).withColumn("detail", F.lit("interval_too_short"))


def next_runs(settings: DataFrame, runs: DataFrame) -> DataFrame:
    """Append ``last_run_at`` and ``next_run_at`` (null when off or never run)."""
    timed = settings.join(last_real_runs(runs), "library_id", "left")
    due_at = F.col("last_run_at") + F.make_interval(hours=F.col("interval_hours"))
    return timed.withColumn("next_run_at", F.when(F.col("enabled"), due_at))


def due_libraries(settings: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Append ``due`` to the settings; a never-run library is not due yet."""
    timed = next_runs(settings, runs)
    return timed.withColumn("due", F.coalesce(F.col("next_run_at") <= now, F.lit(False)))


def baselines(settings: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """First log rows of enabled libraries that never ran: their clock starts now."""
    seen = runs.filter(F.col("status") != "skipped").select("library_id").distinct()
    return settings.filter("enabled").join(seen, "library_id", "left_anti").select(
        "library_id",
        now.alias("started_at"),
        now.alias("finished_at"),
        F.lit("baseline").alias("trigger"),
        F.lit("ok").alias("status"),
        *[F.lit(0).alias(c) for c in ("checked", "updated", "failed")],
    )


def collapse_skips(runs: DataFrame) -> DataFrame:
    """Keep one skip per postponement: the first one after each real run."""
    island = with_running(
        runs, ["library_id"], ["seq"], {"_island": (F.col("status") != "skipped").cast("long")}
    )
    # Only skips can repeat within an island, and their first one is a combined aggregate.
    first = (
        island.filter("status = 'skipped'")
        .groupBy("library_id", "_island")
        .agg(F.min("seq").alias("seq"))
        .select("library_id", "seq", F.lit(True).alias("_keep"))
    )
    return (
        island.join(first, ["library_id", "seq"], "left")
        .filter((F.col("status") != "skipped") | F.col("_keep"))
        .drop("_island", "_keep")
    )


def run_outcomes(results: DataFrame, jobs: DataFrame) -> DataFrame:
    """Log row values per run: a failed job is one failure, a stop keeps its counts.

    ``results`` has (run_id, id, status), ``jobs`` (run_id, state).
    """
    counts = results.groupBy("run_id").agg(
        F.count("*").alias("_checked"),
        F.count_if(F.col("status") == "updated").alias("_updated"),
        F.count_if(F.col("status") == "error").alias("_failed"),
    )
    broken = F.col("state") == "error"
    return jobs.join(counts, "run_id", "left").select(
        "run_id",
        F.when(broken, F.lit("error")).when(F.col("state") == "stopped", F.lit("stopped")).otherwise(F.lit("ok")).alias("status"),
        F.when(broken, F.lit(0)).otherwise(F.coalesce("_checked", F.lit(0))).alias("checked"),
        F.when(broken, F.lit(0)).otherwise(F.coalesce("_updated", F.lit(0))).alias("updated"),
        F.when(broken, F.lit(1)).otherwise(F.coalesce("_failed", F.lit(0))).alias("failed"),
    )


def startup_checks(settings: DataFrame, starts: DataFrame, runs: DataFrame, now: Column, delay: int = STARTUP_DELAY_SECONDS) -> DataFrame:
    """Libraries (library_id) whose check after the start is to be made now.

    ``starts`` (library_id, started_at) tells when each was started last. The check waits ``delay`` seconds and is made
    once: a real run begun since then under the trigger ``startup`` is it, a skipped one leaves it open.
    """
    begun = starts.groupBy("library_id").agg(F.max("started_at").alias("_start"))
    asked = settings.filter("check_on_startup").select("library_id").join(begun, "library_id")
    ripe = asked.filter(F.unix_micros("_start") + delay * 1_000_000 <= F.unix_micros(now))
    made = runs.filter((F.col("status") != "skipped") & (F.col("trigger") == "startup")).groupBy("library_id").agg(
        F.max("started_at").alias("_made")
    )
    return ripe.join(made, "library_id", "left").filter(F.col("_made").isNull() | (F.col("_made") < F.col("_start"))).select("library_id")


def decisions(due: DataFrame, active: DataFrame, startup: DataFrame | None = None) -> DataFrame:
    """Per library: run, skip (something else is running) or wait; with ``startup``, see ``startup_checks``, also the ``trigger``.

    The check after a start goes before the one by interval.
    """
    busy = active.select("library_id").distinct().withColumn("_busy", F.lit(True))
    state = due.join(busy, "library_id", "left")
    wanted = F.col("due")
    if startup is not None:
        state = state.join(startup.select("library_id").distinct().withColumn("_first", F.lit(True)), "library_id", "left")
        first = F.coalesce("_first", F.lit(False))
        state = state.withColumn("trigger", F.when(first, F.lit("startup")).when(F.col("due"), F.lit("interval")))
        wanted = wanted | first
    return state.withColumn(
        "decision",
        F.when(~wanted, F.lit("wait")).when(F.col("_busy"), F.lit("skip")).otherwise(F.lit("run")),
    ).drop("_busy", "_first")

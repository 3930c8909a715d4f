"""Progress events, run log and schedule over the driver's tables.

events are the progress log (a user is a job); orders by customer are the run
log (a customer is a library, an order a run).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import events as E, schedule as S
from ..session import checkpointed, shared_dir
from ..sources.commits import Buckets
from ..sources.pages import table
from ..streaming import progress as P
from ..streaming.joblog import JobLog
from .fragments import JOB_EVENTS, job_events, micros
from .registry import query

NOW = 1704844800_000000  # 2024-01-10, inside the events' span


@query(f"SELECT job_id, event_id, seq FROM ({JOB_EVENTS})")
def event_seq(spark, d):
    return job_events(spark, d).select("job_id", "event_id", "seq")


@query(f"SELECT job_id, seq, type FROM ({JOB_EVENTS}) WHERE seq > 10")
def event_replay(spark, d):
    return E.replay(job_events(spark, d), 10).select("job_id", "seq", "type")


_END = f"SELECT job_id, min(seq) AS stop FROM ({JOB_EVENTS}) WHERE type = 'done' GROUP BY job_id"


@query(f"""SELECT e.job_id, seq, type FROM ({JOB_EVENTS}) e LEFT JOIN ({_END}) t ON e.job_id = t.job_id WHERE stop IS NULL OR seq <= stop""")
def event_terminal(spark, d):
    return E.until_terminal(job_events(spark, d)).select("job_id", "seq", "type")


def _live(spark, d):
    """Jobs that really end: only every third job's purchases end it, and some stop or fail."""
    amount, job = F.col("amount"), F.col("job_id").cast("long")
    kind = (
        F.when((F.col("type") == "done") & (job % 3 > 0), F.lit("status"))
        .when((F.col("type") == "done") & (amount % 5 == 0), F.lit("error"))
        .otherwise(F.col("type"))
    )
    state = F.when((amount == 7) & (job % 2 == 0), "stopping").when(amount % 3 == 0, "paused").otherwise("running")
    return job_events(spark, d).withColumn("type", kind).withColumn("state", F.when(F.col("type") == "status", state))


_LIVE = f"""
    SELECT job_id, seq, us, amount, type, CASE WHEN type = 'status' THEN
             CASE WHEN amount = 7 AND CAST(job_id AS BIGINT) % 2 = 0 THEN 'stopping' WHEN amount % 3 = 0 THEN 'paused' ELSE 'running' END END AS state
    FROM (SELECT job_id, seq, us, amount, CASE WHEN type = 'done' AND CAST(job_id AS BIGINT) % 3 > 0 THEN 'status'
                 WHEN type = 'done' AND amount % 5 = 0 THEN 'error' ELSE type END AS type FROM ({JOB_EVENTS}))
"""
_STATES = f"""
    SELECT job_id, finished_us, events, CASE WHEN ended = 'error' THEN 'error' WHEN ended = 'done' AND stop THEN 'stopped' WHEN ended = 'done' THEN 'done'
             WHEN stop THEN 'stopping' ELSE coalesce(control, 'running') END AS state
    FROM (SELECT job_id, min_by(type, seq) FILTER (type IN ('done', 'error')) AS ended, min(us) FILTER (type IN ('done', 'error')) AS finished_us,
                 max_by(state, seq) FILTER (type = 'status') AS control, coalesce(bool_or(state = 'stopping'), false) AS stop, max(seq) AS events
          FROM ({_LIVE}) GROUP BY job_id)
"""


@query(f"SELECT job_id, state, events FROM ({_STATES})")
def job_state(spark, d):
    return E.job_states(_live(spark, d)).select("job_id", "state", "events")


@query(f"""SELECT job_id, CASE WHEN n % 2 = 0 THEN 'manual' ELSE 'interval' END AS trigger, n % 2 <> 0 AS scheduled FROM (
             SELECT job_id, count(*) AS n, min(us) AS created FROM ({_LIVE}) GROUP BY job_id
             HAVING count(*) FILTER (type IN ('done', 'error')) = 0 ORDER BY created LIMIT 1)""")
def job_active(spark, d):
    live = _live(spark, d)
    jobs = live.groupBy("job_id").agg(F.min("us").alias("created"), F.count("*").alias("n")).withColumn(
        "trigger", F.when(F.col("n") % 2 == 0, F.lit("manual")).otherwise(F.lit("interval"))
    )
    return E.active_job(jobs, live)


@query(f"SELECT job_id, state FROM ({_STATES}) WHERE finished_us IS NULL OR {NOW} - finished_us <= 1800 * 24 * 1000000::BIGINT")
def job_expire(spark, d):
    states = E.job_states(_live(spark, d))
    return E.live_jobs(states, F.timestamp_micros(F.lit(NOW)), 1800 * 24).select("job_id", "state")


@query(f"""SELECT job_id, max_by(CASE WHEN type = 'update_started' THEN 0 ELSE seq END, seq) AS value,
                  greatest(max_by(CASE WHEN type = 'update_started' THEN amount ELSE total END, seq), 1) AS total
           FROM ({JOB_EVENTS}) WHERE type IN ('update_started', 'chapter_downloaded') GROUP BY job_id""")
def job_progress(spark, d):
    return E.job_progress(job_events(spark, d))


@query(f"""SELECT job_id, seq, count(*) OVER w AS delivered, count(*) FILTER (failed) OVER w AS failures
           FROM ({JOB_EVENTS}) WHERE type = 'chapter_downloaded' WINDOW w AS (PARTITION BY job_id ORDER BY seq)""")
def download_running(spark, d):
    return E.download_running(job_events(spark, d)).select("job_id", "seq", "delivered", "failures")


@query(f"""SELECT job_id, seq, coalesce((us - lag(us) OVER (PARTITION BY job_id ORDER BY seq)) // 15000000, 0) AS beats FROM ({JOB_EVENTS})""")
def idle_gaps(spark, d):
    return E.idle_gaps(job_events(spark, d)).select("job_id", "seq", "beats")


@query(f"""SELECT r.job_id, r.type AS asked_at, CASE WHEN state IS NULL THEN 'unknown_job' WHEN state = 'error' THEN 'job_failed'
                  WHEN state IN ('done', 'stopped') THEN 'ready' ELSE 'job_still_running' END AS result
           FROM (SELECT CASE WHEN failed THEN 'gone' ELSE job_id END AS job_id, type, event_id FROM ({JOB_EVENTS})) r
           LEFT JOIN ({_STATES}) s ON r.job_id = s.job_id""")
def result_status(spark, d):
    states = E.job_states(_live(spark, d))
    asked = job_events(spark, d).select(
        F.when(F.col("failed"), F.lit("gone")).otherwise(F.col("job_id")).alias("job_id"), F.col("type").alias("asked_at")
    )
    return E.result_status(asked, states).select("job_id", "asked_at", "result")


@query(f"SELECT job_id, seq, us, type FROM ({JOB_EVENTS})")
def event_log(spark, d):
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    events = job_events(spark, d).select("job_id", "seq", "ts", "type", "state", "failed", "index", "total", "new_chapters")
    P.write_log(events, path)
    return P.read_log(spark, path).select("job_id", "seq", F.unix_micros("ts").alias("us"), "type")


def _runs(spark, d):
    """Run log: orders of a customer by key, which is append order, not time order."""
    o = table(spark, d, "orders")
    status = (
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit("skipped"))
        .when(F.col("o_orderstatus") == "F", F.lit("error")).otherwise(F.lit("ok"))
    )
    return o.select(
        F.col("o_custkey").alias("library_id"), F.col("o_orderkey").alias("seq"),
        F.timestamp_micros(micros(F.col("o_orderdate"))).alias("finished_at"), status.alias("status"),
    )


_RUNS = """
    SELECT o_custkey AS library_id, o_orderkey AS seq, epoch_us(o_orderdate) AS us,
           CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'skipped' WHEN o_orderstatus = 'F' THEN 'error' ELSE 'ok' END AS status
    FROM orders
"""


@query(f"""SELECT library_id, seq, rank FROM (SELECT *, row_number() OVER (PARTITION BY library_id ORDER BY seq DESC) AS rank FROM ({_RUNS})) WHERE rank <= 20""")
def run_log_topk(spark, d):
    return S.newest_runs(_runs(spark, d)).select("library_id", "seq", "rank")


_LAST = f"SELECT library_id, max_by(us, seq) AS last FROM ({_RUNS}) WHERE status <> 'skipped' GROUP BY library_id"


@query(_LAST)
def last_run(spark, d):
    return S.last_real_runs(_runs(spark, d)).select("library_id", F.unix_micros("last_run_at").alias("last"))


def _settings(spark, d):
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("library_id"), (F.col("c_acctbal") > 1000).alias("enabled"),
        F.col("c_nationkey").cast("int").alias("interval_hours"),
    )


_SETTINGS = "SELECT c_custkey AS library_id, c_acctbal > 1000 AS enabled, c_nationkey AS hours FROM customer WHERE c_nationkey >= 1"
_NEXT = f"""SELECT s.library_id, CASE WHEN enabled THEN last + hours * 3600000000::BIGINT END AS next_run
            FROM ({_SETTINGS}) s LEFT JOIN ({_LAST}) l ON s.library_id = l.library_id"""


@query("""SELECT c_custkey AS library_id, CASE WHEN c_nationkey >= 1 THEN 'ok' ELSE 'interval_too_short' END AS detail FROM customer""")
def interval_valid(spark, d):
    good, bad = S.split_settings(_settings(spark, d))
    return good.withColumn("detail", F.lit("ok")).unionByName(bad).select("library_id", "detail")


@query(_NEXT)
def next_run(spark, d):
    timed = S.next_runs(S.split_settings(_settings(spark, d))[0], _runs(spark, d))
    return timed.select("library_id", F.unix_micros("next_run_at").alias("next_run"))


RUN_NOW = 1000000000_000000


def _due(spark, d):
    good = S.split_settings(_settings(spark, d))[0]
    return good, _runs(spark, d), F.timestamp_micros(F.lit(RUN_NOW))


@query(f"""SELECT n.library_id, coalesce(next_run <= {RUN_NOW}, false) AS due, enabled AND last IS NULL AS baseline
           FROM ({_NEXT}) n JOIN ({_SETTINGS}) s ON n.library_id = s.library_id LEFT JOIN ({_LAST}) l ON n.library_id = l.library_id""")
def run_due(spark, d):
    settings, runs, now = _due(spark, d)
    first = S.baselines(settings, runs, now).select("library_id", F.lit(True).alias("baseline"))
    due = S.due_libraries(settings, runs, now).select("library_id", "due")
    return due.join(first, "library_id", "left").fillna(False, ["baseline"])


_ISLANDS = f"SELECT *, count(*) FILTER (status <> 'skipped') OVER (PARTITION BY library_id ORDER BY seq) AS island FROM ({_RUNS})"


@query(f"""SELECT library_id, seq, status FROM (
             SELECT *, row_number() OVER (PARTITION BY library_id, island, status = 'skipped' ORDER BY seq) AS rn FROM ({_ISLANDS}))
           WHERE status <> 'skipped' OR rn = 1""")
def skip_collapse(spark, d):
    return S.collapse_skips(_runs(spark, d)).select("library_id", "seq", "status")


@query("""WITH r AS (SELECT o_custkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'O' THEN 'updated' ELSE 'up_to_date' END AS status FROM orders),
               j AS (SELECT c_custkey AS run_id, CASE WHEN c_nationkey < 5 THEN 'error' WHEN c_nationkey < 10 THEN 'stopped' ELSE 'done' END AS state FROM customer)
          SELECT j.run_id, CASE state WHEN 'done' THEN 'ok' ELSE state END AS status, CASE WHEN state = 'error' THEN 0 ELSE count(r.run_id) END AS checked,
                 CASE WHEN state = 'error' THEN 0 ELSE count(*) FILTER (r.status = 'updated') END AS updated,
                 CASE WHEN state = 'error' THEN 1 ELSE count(*) FILTER (r.status = 'error') END AS failed
          FROM j LEFT JOIN r ON j.run_id = r.run_id GROUP BY j.run_id, state""")
def run_outcome(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "error").when(F.col("o_orderstatus") == "O", "updated").otherwise("up_to_date")
    results = table(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("id"), status.alias("status"))
    nation = F.col("c_nationkey")
    jobs = table(spark, d, "customer").select(
        F.col("c_custkey").alias("run_id"), F.when(nation < 5, "error").when(nation < 10, "stopped").otherwise("done").alias("state")
    )
    return S.run_outcomes(results, jobs)


@query(f"""SELECT n.library_id, CASE WHEN NOT coalesce(next_run <= {RUN_NOW}, false) THEN 'wait'
                  WHEN n.library_id IN (SELECT CAST(job_id AS BIGINT) FROM ({_STATES}) WHERE finished_us IS NULL) THEN 'skip' ELSE 'run' END AS decision
           FROM ({_NEXT}) n""")
def run_decision(spark, d):
    settings, runs, now = _due(spark, d)
    states = E.job_states(_live(spark, d))
    active = states.filter("finished_at is null").select(F.col("job_id").cast("long").alias("library_id"))
    return S.decisions(S.due_libraries(settings, runs, now), active).select("library_id", "decision")


_STARTS = f"SELECT n_nationkey AS k, {RUN_NOW} - n_nationkey * 5000000::BIGINT AS start FROM nation"


@query(f"""WITH first AS (SELECT s.library_id FROM ({_SETTINGS}) s JOIN ({_STARTS}) n ON s.library_id % 25 = n.k
                          LEFT JOIN (SELECT library_id, max(us) AS made FROM ({_RUNS}) WHERE status <> 'skipped' AND seq % 3 = 0 GROUP BY library_id) r
                            ON r.library_id = s.library_id
                          WHERE hours % 2 = 0 AND start + 30000000 <= {RUN_NOW} AND (made IS NULL OR made < start)),
                d AS (SELECT n.library_id, coalesce(next_run <= {RUN_NOW}, false) AS due, f.library_id IS NOT NULL AS early,
                             n.library_id IN (SELECT CAST(job_id AS BIGINT) FROM ({_STATES}) WHERE finished_us IS NULL) AS busy
                      FROM ({_NEXT}) n LEFT JOIN first f ON n.library_id = f.library_id)
           SELECT library_id, CASE WHEN early THEN 'startup' WHEN due THEN 'interval' END AS trigger,
                  CASE WHEN NOT (due OR early) THEN 'wait' WHEN busy THEN 'skip' ELSE 'run' END AS decision FROM d""")
def startup_decision(spark, d):
    """Libraries of a nation were started together; every third run was made after a start."""
    settings, runs, now = _due(spark, d)
    checked = settings.withColumn("check_on_startup", F.col("interval_hours") % 2 == 0)
    begun = table(spark, d, "nation").select("n_nationkey", F.timestamp_micros(F.lit(RUN_NOW) - F.col("n_nationkey") * 5_000_000).alias("started_at"))
    starts = settings.select("library_id", (F.col("library_id") % 25).alias("n_nationkey")).join(begun, "n_nationkey")
    told = runs.withColumns({"trigger": F.when(F.col("seq") % 3 == 0, "startup").otherwise("interval"), "started_at": F.col("finished_at")})
    states = E.job_states(_live(spark, d))
    active = states.filter("finished_at is null").select(F.col("job_id").cast("long").alias("library_id"))
    first = S.startup_checks(checked, starts, told, now)
    return S.decisions(S.due_libraries(settings, runs, now), active, first).select("library_id", "trigger", "decision")


@query(f"SELECT job_id, seq, type, 1 AS times FROM ({_LIVE})")
def stream_dedup(spark, d):
    """A log in which every third event is written again, followed as a stream: each is delivered once."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = _live(spark, d).select("job_id", "seq", "ts", "type", "state", "failed", "index", "total", "new_chapters")
    P.write_log(events.repartition(3), f"{root}/log")
    P.write_log(events.filter("seq % 3 = 0").repartition(2), f"{root}/log")
    once = P.deliver_once(P.follow_log(spark, f"{root}/log", files_per_batch=2), late="3650 days")
    run = (
        once.select("job_id", "seq", "type").writeStream.format("parquet").option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema("job_id string, seq long, type string").parquet(f"{root}/out").groupBy("job_id", "seq", "type").agg(
        F.count("*").alias("times")
    )


_EVENT_COLUMNS = ["job_id", "seq", "ts", "type", "state", "failed", "index", "total", "new_chapters"]


@query(f"SELECT job_id, state, events FROM ({_STATES})")
def stream_job_state(spark, d):
    """The log followed as a stream into bucketed state gives the states of the batch fold."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    P.write_log(_live(spark, d).select(_EVENT_COLUMNS).repartition(4), f"{root}/log")
    table = Buckets(spark, f"{root}/state", P.FOLD_SCHEMA, "job_id")
    followed = P.follow_log(spark, f"{root}/log", files_per_batch=2)
    run = followed.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(
        P.fold_into(table, ttl=None)
    ).start()
    run.awaitTermination()
    return P.job_folds(table, ttl=None).select("job_id", "state", "events")


_TTL, _LATE = 3 * 86_400, 86_400
_ENDS = f"SELECT job_id, min(us) AS finished_us FROM ({_LIVE}) WHERE type IN ('done', 'error') GROUP BY job_id"
_CLOCK = f"(SELECT max(us) // 1000 - {_LATE * 1000} FROM ({_LIVE}) WHERE type IN ('done', 'error'))"


@query(f"""WITH e AS (SELECT job_id, finished_us, false AS late FROM ({_ENDS})
                      UNION ALL SELECT 'late-' || job_id, min(us), true FROM ({_LIVE}) WHERE type IN ('done', 'error') GROUP BY job_id
                      HAVING min(us) // 1000 < {_CLOCK})
           SELECT job_id, 'finished' AS phase, finished_us, late FROM e
           UNION ALL SELECT job_id, 'expired', finished_us, false FROM e WHERE finished_us // 1000 + {_TTL * 1000} <= {_CLOCK}""")
def stream_expire(spark, d):
    """Retention as a stream: all ends, then ends of other jobs that come a batch after the clock has passed them."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = checkpointed(_live(spark, d).select(_EVENT_COLUMNS))
    P.write_log(events.coalesce(4), f"{root}/log")
    ends = events.filter(F.col("type").isin("done", "error"))
    newest = ends.agg(F.unix_millis(F.max("ts"))).first()[0] or 0
    first = ends.groupBy("job_id").agg(F.min_by(F.struct(*_EVENT_COLUMNS[1:]), "ts").alias("e")).select("job_id", "e.*")
    behind = first.filter(F.unix_millis("ts") < newest - _LATE * 1000)
    out, checkpoint = f"{root}/out", f"{root}/checkpoint"

    def follow():
        phases = P.expiring_jobs(P.follow_log(spark, f"{root}/log"), _TTL, f"{_LATE} seconds")
        with P.with_rocksdb(spark):
            run = phases.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            run.awaitTermination()

    follow()
    P.write_log(behind.select(F.concat(F.lit("late-"), "job_id").alias("job_id"), *_EVENT_COLUMNS[1:]).coalesce(1), f"{root}/log")
    follow()
    return spark.read.schema(P.EXPIRY_SCHEMA).parquet(out)


@query(f"""SELECT job_id, before AS from_us, us AS until_us, (us - before) // {3600 * 1_000_000} AS beats FROM (
             SELECT job_id, us, lag(us) OVER (PARTITION BY job_id ORDER BY us) AS before FROM ({_LIVE})) WHERE us - before >= {3600 * 1_000_000}""")
def stream_idle(spark, d):
    """Silences of an hour and more from session windows over the followed log; a last event moves the clock past all others."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = checkpointed(_live(spark, d).select(_EVENT_COLUMNS))
    P.write_log(events.coalesce(4), f"{root}/log")
    last = events.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit("clock").alias("job_id"))
    columns = [F.col(c) if c in ("ts", "job_id") else F.lit(None).cast(events.schema[c].dataType).alias(c) for c in _EVENT_COLUMNS]
    P.write_log(last.select(columns), f"{root}/log")
    spans = P.active_spans(P.follow_log(spark, f"{root}/log"), 3600, "1 day")
    run = spans.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(
        availableNow=True
    ).start()
    run.awaitTermination()
    found = P.silences(spark.read.schema(spans.schema).parquet(f"{root}/out").filter("job_id <> 'clock'"), 3600)
    return found.select("job_id", F.unix_micros("from").alias("from_us"), F.unix_micros("until").alias("until_us"), "beats")


@query(f"SELECT job_id, seq, type FROM ({_LIVE}) WHERE seq > CASE WHEN job_id = '7' THEN 3 ELSE 10 END")
def stream_replay(spark, d):
    """The log followed from index 10, one job from 3: half of it as history, then, after a restart, the rest."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = checkpointed(_live(spark, d).select(_EVENT_COLUMNS))
    log = JobLog(spark, f"{root}/log")

    def follow():
        run = log.follow(10, {"7": 3}).select("job_id", "seq", "type").writeStream.format("parquet").option("path", f"{root}/out").option(
            "checkpointLocation", f"{root}/checkpoint"
        ).trigger(availableNow=True).start()
        run.awaitTermination()

    log.append(events.filter("seq % 2 = 0"))
    follow()
    log.append(events.filter("seq % 4 = 1"))
    log.append(events.filter("seq % 4 = 3"))
    follow()
    return spark.read.schema("job_id string, seq long, type string").parquet(f"{root}/out")

"""One batch and several micro-batches must agree."""

import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from chapterloom.operators import events as E
from chapterloom.sources.commits import Buckets, CommitLog, StaleSnapshot
from chapterloom.streaming import progress as P
from chapterloom.streaming.joblog import JobLog


def _log(spark, path, jobs=20, files=4):
    rng = random.Random(11)
    rows, clock = [], 1_700_000_000
    for j in range(jobs):
        for seq in range(1, rng.randrange(3, 12)):
            kind = rng.choice(["metadata", "status", "chapter_downloaded", "status"])
            rows.append((f"j{j}", seq, kind, rng.choice(["paused", "running", "stopping"]) if kind == "status" else None))
        if j % 3:
            rows.append((f"j{j}", 99, "done" if j % 2 else "error", None))
    rows = [(*r, clock + i * 20) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "job_id string, seq long, type string, state string, at long")
    df = df.withColumn("ts", F.timestamp_seconds("at")).drop("at")
    full = df.withColumns({"failed": F.lit(False), "index": F.col("seq"), "total": F.lit(9).cast("long"), "new_chapters": F.lit(0).cast("long")})
    P.write_log(full.repartitionByRange(files, "ts"), path)
    return full


def _run(query_writer, tmp_path, name):
    q = query_writer.option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_bucketed_fold_equals_batch(spark, tmp_path):
    full = _log(spark, str(tmp_path / "log"))
    table = Buckets(spark, str(tmp_path / "folds"), P.FOLD_SCHEMA, "job_id", 8)
    merge = P.fold_into(table, ttl=10**9)
    stream = P.follow_log(spark, str(tmp_path / "log"), files_per_batch=1)
    _run(stream.writeStream.foreachBatch(merge), tmp_path, "fold")
    want = {r.job_id: r.state for r in E.job_states(full).collect()}
    assert {r.job_id: r.state for r in P.job_folds(table, 10**9).collect()} == want
    # A repeated batch finds its number committed and changes nothing.
    version, content = table.state()
    merge(full, content["batch"])
    assert table.state() == (version, content)


def test_empty_log_and_empty_state(spark, tmp_path):
    empty = _log(spark, str(tmp_path / "other")).limit(0)
    P.write_log(empty, str(tmp_path / "log"))
    table = Buckets(spark, str(tmp_path / "folds"), P.FOLD_SCHEMA, "job_id")
    _run(P.follow_log(spark, str(tmp_path / "log")).writeStream.foreachBatch(P.fold_into(table)), tmp_path, "fold")
    assert P.job_folds(table).count() == 0 and table.state()[0] == 0
    P.fold_into(table)(empty, 0)
    assert table.state()[0] == 0 and table.vacuum() == []


def _jobs(spark, names, seq=1, kind="status", at=0):
    rows = [(n, seq, kind, "running" if kind == "status" else None, False, 1, 1, 0) for n in names]
    df = spark.createDataFrame(rows, "job_id string, seq long, type string, state string, failed boolean, index long, total long, new_chapters long")
    return df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000 + at)))


def test_a_batch_writes_only_the_buckets_it_touches(spark, tmp_path):
    table = Buckets(spark, str(tmp_path / "folds"), P.FOLD_SCHEMA, "job_id", 16)
    merge = P.fold_into(table)
    merge(_jobs(spark, [f"j{i}" for i in range(400)]), 0)
    before = table.state()[1]["buckets"]
    merge(_jobs(spark, ["j3"], 2, "done", 10), 1)
    version, content = table.state()
    changed = [b for b, f in content["buckets"].items() if before[b] != f]
    assert len(before) == 16 and len(changed) == 1 and content["replaced"] == [before[changed[0]]]
    assert {r.job_id for r in P.job_folds(table).filter("state = 'done'").collect()} == {"j3"}
    # A reader of the commit before is not disturbed until the old folder is removed.
    assert table._rows(sorted(before.values())).count() == 400
    assert table.vacuum() == [before[changed[0]]] and P.job_folds(table).count() == 400 and table.log.versions() == [version]
    # Retention: the finished job goes as the clock passes, whether or not its bucket is written.
    merge(_jobs(spark, ["other"], 1, "status", 10_000), 2)
    assert P.job_folds(table).filter("job_id = 'j3'").count() == 0 and P.job_folds(table).count() == 400


def test_of_two_racing_writers_one_wins(spark, tmp_path):
    table = Buckets(spark, str(tmp_path / "t"), "k string, n long", "k", 4)

    def total(rows):
        return rows.groupBy("k").agg(F.sum("n").alias("n"))

    def rows(n):
        return spark.createDataFrame([(f"k{i}", n) for i in range(20)], "k string, n long")

    table.merge(rows(1), total)
    known = table.state()

    def write(n):
        try:
            return table.merge(rows(n), total, known=known)
        except StaleSnapshot:
            return "stale"

    with ThreadPoolExecutor(6) as pool:
        said = list(pool.map(write, [10, 20, 30, 40, 50, 60]))
    assert sorted(map(str, said)) == ["True", *["stale"] * 5]
    won = [10, 20, 30, 40, 50, 60][said.index(True)]
    assert {r.n for r in table.read().collect()} == {1 + won} and table.state()[0] == known[0] + 1
    assert len(table.vacuum()) == 4 * 6 and table.read().count() == 20
    log = CommitLog(spark, str(tmp_path / "log"))

    def publish(n):
        try:
            log.publish(1, {"n": n})
            return n
        except StaleSnapshot:
            return None

    with ThreadPoolExecutor(8) as pool:
        winners = [n for n in pool.map(publish, range(40)) if n is not None]
    assert len(winners) == 1 and log.latest() == (1, {"n": winners[0]})


def test_duplicates_are_delivered_once(spark, tmp_path):
    full = _log(spark, str(tmp_path / "log"))
    P.write_log(full, str(tmp_path / "log"))
    stream = P.deliver_once(P.follow_log(spark, str(tmp_path / "log")), "30 days")
    out = str(tmp_path / "out")
    _run(stream.writeStream.format("parquet").option("path", out).outputMode("append"), tmp_path, "once")
    assert spark.read.parquet(out).count() == full.count()


def test_retention_expires_finished_jobs(spark, tmp_path):
    full = _log(spark, str(tmp_path / "log"))
    P.write_log(_jobs(spark, ["last"], 1, "done", 500_000), str(tmp_path / "log"))
    out = str(tmp_path / "out")

    def follow():
        stream = P.expiring_jobs(P.follow_log(spark, str(tmp_path / "log"), files_per_batch=10))
        with P.with_rocksdb(spark):
            _run(stream.writeStream.format("parquet").option("path", out).outputMode("append"), tmp_path, "ttl")
        return spark.read.schema(P.EXPIRY_SCHEMA).parquet(out)

    rows = follow().collect()
    finished = {r.job_id for r in rows if r.phase == "finished"}
    expired = {r.job_id for r in rows if r.phase == "expired"}
    ended = {r.job_id for r in full.filter("type in ('done', 'error')").collect()}
    assert finished == ended | {"last"} and expired == ended and not any(r.late for r in rows)
    # Ends behind the clock: one past its retention, one within; a second end of a job in its retention is none.
    late = _jobs(spark, ["old"], 1, "done", 1000).union(_jobs(spark, ["recent", "last"], 1, "error", 499_300 - 1800 + 1200))
    P.write_log(late.union(_jobs(spark, ["last"], 2, "done", 500_000)), str(tmp_path / "log"))
    again = follow()
    assert sorted((r.job_id, r.phase, r.late) for r in again.filter("job_id in ('old', 'recent', 'last')").collect()) == [
        ("last", "finished", False), ("old", "expired", False), ("old", "finished", True), ("recent", "finished", True)]
    assert {r.job_id for r in P.rejected(again).collect()} == {"old", "recent"}


def test_log_followed_from_an_index_and_restarted(spark, tmp_path):
    log, out = JobLog(spark, str(tmp_path / "log")), str(tmp_path / "out")

    def follow(**options):
        stream = log.follow(**options)
        _run(stream.writeStream.format("parquet").option("path", out + str(options)).outputMode("append"), tmp_path, str(options))
        return sorted((r.job_id, r.seq) for r in spark.read.schema(P.EVENT_SCHEMA).parquet(out + str(options)).collect())

    some, one = {"after": 2, "jobs": {"a": 0, "b": 4}}, {"jobs": {"b": 1}, "only": True}
    assert follow(**some) == []
    for seq in (1, 2, 3):
        log.append(_jobs(spark, ["a", "b", "c"], seq))
    assert follow(**some) == [("a", 1), ("a", 2), ("a", 3), ("c", 3)]
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda seq: log.append(_jobs(spark, ["a", "b"], seq).repartition(2)), (4, 5, 6, 7)))
    assert sorted(numbers) == [4, 5, 6, 7] and log.read().count() == 17
    want = [("a", s) for s in range(1, 8)] + [("b", s) for s in (5, 6, 7)] + [("c", 3)]
    assert follow(**some) == want and follow(**some) == want
    assert follow(**one) == [("b", s) for s in range(2, 8)]


def test_silences_of_a_followed_log_equal_the_batch(spark, tmp_path):
    full = _log(spark, str(tmp_path / "log"), files=3)
    P.write_log(_jobs(spark, ["clock"], 1, "status", 10**6), str(tmp_path / "log"))
    stream = P.active_spans(P.follow_log(spark, str(tmp_path / "log"), files_per_batch=1), 15, "1 hour")
    out = str(tmp_path / "out")
    _run(stream.writeStream.format("parquet").option("path", out).outputMode("append"), tmp_path, "idle")
    found = P.silences(spark.read.parquet(out).filter("job_id <> 'clock'"))
    want = E.idle_gaps(full).filter("beats > 0")
    assert sorted((r.job_id, r.until, r.beats) for r in found.collect()) == sorted((r.job_id, r.ts, r.beats) for r in want.collect())

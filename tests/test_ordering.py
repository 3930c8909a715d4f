"""The sliced windows must equal ordinary ones, whatever the key sizes."""

import random

from pyspark.sql import functions as F

from chapterloom.operators import ordering as O


def _rows(seed=7):
    rng = random.Random(seed)
    keys = ["hot"] * 400 + [f"k{i % 40}" for i in range(400)] + [None] * 200
    return [(k, rng.randrange(50), i, rng.randrange(9)) for i, k in enumerate(keys)]


def _frame(spark):
    return spark.createDataFrame(_rows(), "k string, t int, id int, v int").repartition(5)


def test_running_and_ordinal(spark):
    df = _frame(spark)
    cols = ["k", "t", "id", "v", "n", "s"]
    amounts = {"n": F.lit(1).cast("long"), "s": F.col("v").cast("long")}
    plain = O.with_running(df, ["k"], ["t", "id"], amounts).select(cols).collect()
    sliced = O.with_running(df, ["k"], ["t", "id"], amounts, span=7).select(cols).collect()
    assert sorted(map(str, plain)) == sorted(map(str, sliced)) and len(plain) == 1000
    model = {}
    for k, t, i, v in sorted(_rows(), key=lambda r: (str(r[0]), r[1], r[2])):
        n, s = model.get((k, "last"), (0, 0))
        model[(k, "last")] = (n + 1, s + v)
        model[i] = (n + 1, s + v)
    assert all(model[r.id] == (r.n, r.s) for r in sliced)


def test_previous(spark):
    df = _frame(spark)
    cols = ["k", "t", "id", "before"]
    plain = O.with_previous(df, ["k"], ["t", "id"], {"before": "v"}).select(cols).collect()
    sliced = O.with_previous(df, ["k"], ["t", "id"], {"before": "v"}, span=7).select(cols).collect()
    assert sorted(map(str, plain)) == sorted(map(str, sliced))
    assert sum(r.before is None for r in sliced) == 42
    # A null value of the row before stays one, also over slices.
    odd = df.withColumn("v", F.when(F.col("id") % 3 > 0, F.col("v")))
    got = [{r.id: r.before for r in O.with_previous(odd, ["k"], ["t", "id"], {"before": "v"}, span=s).collect()} for s in (None, 7, 1000)]
    assert got[0] == got[1] == got[2]


def test_building_a_window_starts_no_job_and_totals_are_combined_first(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("ordering", "build")
    out = O.with_ordinal(_frame(spark), ["k"], ["t", "id"])
    assert not tracker.getJobIdsForGroup("ordering")
    spark.sparkContext._jsc.clearJobGroup()
    assert "partial_sum" in out._jdf.queryExecution().executedPlan().toString()


def test_slices_follow_every_kind_of_order(spark):
    rows = [(1, None), (1, "a"), (1, "abcde"), (1, "abcdf"), (1, "b"), (1, "é")]
    df = spark.createDataFrame(rows, "k int, t string")
    for kind in ("string", "binary"):
        got = O.with_ordinal(df.withColumn("t", F.col("t").cast(kind)), ["k"], ["t"]).orderBy("seq").collect()
        assert [r.seq for r in got] == [1, 2, 3, 4, 5, 6] and got[0].t is None
    times = spark.sql("SELECT 1 AS k, timestamp_seconds(id * 40000) AS t, id FROM range(20)")
    for column in ("t", "date(t)"):
        got = O.with_running(times.withColumn("u", F.expr(column)), ["k"], ["u", "id"], {"s": F.col("id")}).collect()
        assert all(r.s == r.id * (r.id + 1) // 2 for r in got)


def test_top_k_is_cut_before_the_shuffle(spark):
    top = O.top_k(_frame(spark), ["k"], [F.desc("id")], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert top.count() == 42 * 3


def test_a_hot_key_with_one_first_value_is_split_over_tasks(spark):
    n = 6 * O.SPAN
    hot = spark.range(n).select(F.lit("hot").alias("k"), F.lit(1).alias("t"), "id")
    rest = spark.range(2 * n).select(F.concat(F.lit("k"), (F.col("id") % 100).cast("string")).alias("k"), (F.col("id") % 7).cast("int").alias("t"), "id")
    keep = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as it stands in the plan, without a split at run time
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (O.with_ordinal(hot.union(rest), ["k"], ["t", "id"]), O.with_previous(hot.union(rest), ["k"], ["t", "id"], {"seq": "id"})):
            sizes = out.filter("k = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
            assert len(sizes) > 1 and max(r["count"] for r in sizes) <= n / 2
    finally:
        for c, v in keep.items():
            spark.conf.set(c, v)
    seq = O.with_ordinal(hot.union(rest), ["k"], ["t", "id"])
    assert seq.filter("k = 'hot' and seq <> id + 1").count() == 0
    lag = O.with_previous(hot.union(rest), ["k"], ["t", "id"], {"b": "id"})
    assert lag.filter("k = 'hot' and coalesce(b, -1) <> id - 1").count() == 0
    assert lag.filter("b is null").count() == 101

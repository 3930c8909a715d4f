"""Every registered query: same rows as its SQL, and no plan that cannot grow."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from check import open_tables, spark_rows, sql_rows

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(entry_points.queries())
BAD_NODES = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def db():
    return open_tables(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    df = entry_points.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert [n for n in BAD_NODES if n in plan] == []
    checks = entry_points.oracle_sql()
    got = spark_rows(df)
    if name in checks:
        assert got == sql_rows(db, checks[name])
    else:
        assert got[1]


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() == 50


def test_pages_are_routed_without_a_shuffle(spark):
    for df in (entry_points.entry(spark), entry_points.queries()["novel_metadata"](spark, FOLDER)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and plan.count("MapInArrow") == 1


def test_literal_rules_route_like_the_table(spark):
    from chapterloom.operators import routing as R
    from chapterloom.plans.site_rules import SITES, rules_table

    urls = ["https://www.royalroad.com/f", "http://ROYALROAD.com", "https://xroyalroad.com/", "https://a.b.freewebnovel.com:8/x", "nope", None, ""]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    by_table = {r.url: r.site for r in R.route(df, rules_table(spark)).collect()}
    got = {r.url: r.s for r in df.select("url", R.site_of(F.col("url"), SITES).alias("s")).collect()}
    assert got == by_table


def test_scans_read_only_what_they_need(spark):
    plan = entry_points.queries()["url_host"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan
    plan = entry_points.queries()["library_record"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(c_acctbal,0.0)" in plan

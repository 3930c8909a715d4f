"""Settings as they may be stored, checks after a start, unreadable pages."""

import json

import pytest
from pyspark.sql import functions as F

from chapterloom.operators import cleaning as C, schedule as S
from chapterloom.functions.nodes import el, path
from chapterloom.sources import html_nodes as H, snapshots as N


@pytest.mark.parametrize(
    "stored,want",
    [
        ({"auto_update_enabled": True, "auto_update_interval_hours": "24", "check_on_startup": "yes"}, (True, 24, True)),
        ({"auto_update_enabled": "on", "auto_update_interval_hours": 6.0, "check_on_startup": 0}, (True, 6, False)),
        ({"auto_update_enabled": 1, "auto_update_interval_hours": " 12 "}, (True, 12, False)),
        ({"auto_update_enabled": True, "auto_update_interval_hours": 1.5}, (False, 24, False)),
        ({"auto_update_enabled": "maybe", "auto_update_interval_hours": 3}, (False, 24, False)),
        ({"auto_update_enabled": True, "auto_update_interval_hours": None}, (False, 24, False)),
        ({"auto_update_enabled": True, "auto_update_interval_hours": 0}, (False, 24, False)),
        ({}, (False, 24, False)),
        ([1], (False, 24, False)),
    ],
)
def test_settings(spark, stored, want):
    docs = spark.createDataFrame([(1, json.dumps({"settings": stored}))], "k int, content string")
    (row,) = N.settings_rows(docs, ["k"], F.col("content")).collect()
    assert (row.enabled, row.interval_hours, row.check_on_startup) == want


def test_check_after_a_start(spark):
    at = F.timestamp_seconds
    settings = spark.createDataFrame([(i, i != 9, i % 2 == 0) for i in range(1, 10)], "library_id int, check_on_startup boolean, due boolean")
    starts = spark.createDataFrame([(i, 100 if i < 8 else 190) for i in range(1, 10)] + [(1, 50), (7, 195)], "library_id int, s long").select("library_id", at("s").alias("started_at"))
    runs = spark.createDataFrame(
        [(2, "ok", "startup", 140), (3, "skipped", "startup", 140), (4, "ok", "interval", 140), (5, "error", "startup", 99)], "library_id int, status string, trigger string, s long"
    ).select("library_id", "status", "trigger", at("s").alias("started_at"))
    first = S.startup_checks(settings, starts, runs, at(F.lit(200)))
    assert {r.library_id for r in first.collect()} == {1, 3, 4, 5, 6}
    active = spark.createDataFrame([(3,), (4,), (8,)], "library_id int")
    got = {r.library_id: (r.decision, r.trigger) for r in S.decisions(settings, active, first).collect()}
    assert got == {1: ("run", "startup"), 2: ("run", "interval"), 3: ("skip", "startup"), 4: ("skip", "startup"), 5: ("run", "startup"),
                   6: ("run", "startup"), 7: ("wait", None), 8: ("skip", "interval"), 9: ("wait", None)}


def test_page_that_cannot_be_parsed_has_its_own_status(spark, monkeypatch):
    class Refuses(H._Nodes):
        def feed(self, data):
            if "refuse" in data:
                raise AssertionError(data)
            super().feed(data)

    monkeypatch.setattr(H, "_Nodes", Refuses)
    assert H.try_parse("refuse") is None and H.parse_nodes("refuse") == [] and H.try_parse("") == [] and H.try_parse(None) == []
    pages = spark.createDataFrame([(1, "<div class='c'>x</div>"), (2, "<p>x</p>"), (3, "<div class='c'></div>")], "k int, html string")
    read = H.with_nodes(pages, parsed="parsed").withColumn("parsed", F.col("k") != 2)
    done = C.chapter_contents(read, [path(el("div", "c"))], [F.lit("t")])
    assert {r.k: r.status for r in done.collect()} == {1: "ok", 2: "parse_error", 3: "empty_after_cleaning"} and "parsed" not in done.columns
    assert H.with_nodes(pages).columns == ["k", "nodes"]

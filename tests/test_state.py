import base64
import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from chapterloom.operators import books as B, events as E, imports as I, library as L, naming, schedule as S
from chapterloom.sources.commits import StaleSnapshot
from chapterloom.sources import archives as A, exports as X, snapshots as N


def name_model(arrivals, existing):
    used, out = set(existing), {}
    for slug, order in sorted(arrivals, key=lambda a: a[1]):
        names = [slug] + [f"{slug}-{k}" for k in range(2, 1000)]
        stem = next((n for n in names if n not in used), None)
        if stem:
            used.add(stem)
        out[order] = stem
    return out


def test_free_names_against_a_loop(spark):
    rng = random.Random(5)
    slugs = ["x", "x-2", "x-2-3", "y", "z-5", "w-1000", "w"]
    arrivals = [(rng.choice(slugs), i) for i in range(120)] + [("many", i) for i in range(200, 1300)]
    existing = ["x-3", "y", "y-2", "z-5-2", "many-7", "other"]
    a = spark.createDataFrame(arrivals, "slug string, arrival long").repartition(3)
    e = spark.createDataFrame([(s,) for s in existing], "stem string")
    got = {r.arrival: r.stem for r in naming.free_names(a, e).collect()}
    assert got == name_model(arrivals, existing)


def test_skips_collapse_like_a_loop(spark):
    rng = random.Random(9)
    rows, want = [], set()
    for lib in range(60):
        recorded = False
        for seq in range(1, rng.randrange(2, 30)):
            status = rng.choice(["skipped", "skipped", "ok", "error", "stopped"])
            rows.append((lib, seq, status))
            if status != "skipped":
                recorded = False
                want.add((lib, seq))
            elif not recorded:
                recorded = True
                want.add((lib, seq))
    df = spark.createDataFrame(rows, "library_id int, seq int, status string")
    assert {(r.library_id, r.seq) for r in S.collapse_skips(df).collect()} == want


def test_update_keeps_quirks(spark):
    lib = spark.createDataFrame(
        [("a", "A", True, 10, "u10"), ("b", "B", True, 2, "other"), ("c", "C", False, 5, "u5"), ("d", "D", True, 99, "u99"),
         ("e", "E", True, 2, "moved"), ("f", "F", True, 0, None)],
        "id string, title string, has_file boolean, chapter_count int, last_chapter_url string")
    sizes = {"a": 13, "b": 2, "c": 9, "d": 3, "e": 4, "f": 2}
    cat = spark.createDataFrame([(i, n, f"t{n}", f"u{n}") for i, k in sizes.items() for n in range(1, k + 1)],
                                "id string, chapter_index int, title string, url string")
    got = {r.id: (r.status, r.added_chapters, r.chapter_count, r.detail) for r in L.update_all(lib, cat).collect()}
    assert got == {
        "a": ("updated", 3, 13, None),
        "b": ("up_to_date", 0, 2, None),  # the shift note is lost when nothing is new
        "c": ("no_file", 0, 5, "no_epub_on_disk"),
        "d": ("up_to_date", 0, 99, None),  # a list shorter than the stored count
        "e": ("updated", 2, 4, "chapter_list_shifted"),
        "f": ("updated", 2, 2, None),
    }


def test_long_updates_are_one_row(spark):
    lib = spark.createDataFrame([("a", "A", True, 5, "moved")],
                                "id string, title string, has_file boolean, chapter_count int, last_chapter_url string")
    cat = spark.range(1, 2506).select(F.lit("a").alias("id"), F.col("id").alias("chapter_index"), F.lit("t").alias("title"),
                                      F.concat(F.lit("u"), "id").alias("url"))
    outcomes = cat.select("id", "chapter_index", (F.col("chapter_index") > 2000).alias("failed"), F.lit("x").alias("reason"))
    (row,) = L.update_all(lib, cat, outcomes).collect()
    assert row.added_chapters == 2500
    noted = L.update_warnings(lib, cat, outcomes).orderBy("chapter_index").collect()
    assert [r.warning for r in noted] == [f"#{i} t: x" for i in range(2001, 2506)]
    assert row.detail == "; ".join(["chapter_list_shifted"] + [f"#{i} t: x" for i in range(2001, 2506)])
    one = L.apply_updates(lib.withColumn("updated_at", F.lit("old")), L.update_all(lib, cat, outcomes), F.lit("new")).collect()
    assert [(r.chapter_count, r.last_chapter_url, r.updated_at) for r in one] == [(2505, "u2505", "new")]


def _export_rows():
    book = b"PK\x03\x04rest"
    uri = "data:application/epub+zip;base64," + base64.b64encode(book).decode()
    return [("https://m.test/a/", "Title A", uri), ("https://m.test/b", " ", base64.b64encode(book).decode()),
            ("https://m.test/bad", "Bad", "data:;base64,AAAA"), ("", "No url", uri), (" https://m.test/a/ ", "Again", uri)]


def test_exports_in_both_forms(spark):
    rows = _export_rows()
    keys = ("LibStoryURL", "LibFilename", "LibEpub")
    as_json = json.dumps({"Library": [dict(zip(keys, r)) for r in rows] + ["odd", 5]}).encode()
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        for i, r in enumerate(rows):
            for k, v in zip(keys, r):
                z.writestr(f"Library/{i + 9}/{k}", v)
        z.writestr("Library/2/LibStoryURL", b"\xff\xfe")
        z.writestr("LibraryCountEntries.txt", "1")
    docs = [(1, as_json), (2, box.getvalue()), (3, b"{not json"), (4, b"PK\x03\x04broken"), (5, b'{"Library": 7}')]
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in docs], "export_id int, content binary")
    built = I.build_rows(X.parse_exports(df))
    got = {}
    for r in sorted(built.collect(), key=lambda r: (r.export_id, r.position)):
        got.setdefault(r.export_id, []).append((r.source_url, r.title, bytes(r.payload)))
    want = [("https://m.test/a/", "Title A", b"PK\x03\x04rest"), ("https://m.test/b", "b", b"PK\x03\x04rest"),
            ("https://m.test/a/", "Again", b"PK\x03\x04rest")]
    assert got == {1: want, 2: want}
    assert {r.export_id for r in X.unreadable_exports(df, built).collect()} == {3, 4, 5}
    marked = I.mark_skips(built.filter("export_id = 1"), spark.createDataFrame([], "id string"))
    assert [r.skip for r in marked.orderBy("position").collect()] == [False, False, True]


def test_library_files(spark, tmp_path):
    good = {"id": "1", "source_url": "u", "parser": "p", "title": "T", "created_at": "a", "updated_at": "b", "chapter_count": 4}
    bad_rows = [{"id": "2"}, {**good, "chapter_count": "many"}, "text"]
    (tmp_path / "one.json").write_text(json.dumps({"version": 1, "entries": [good, *bad_rows]}, indent=2))
    (tmp_path / "two.json").write_text('{"entries": [')
    rows = N.library_entries(N.read_documents(spark, str(tmp_path)), ["path"], F.col("content")).collect()
    assert [(r.id, r.author, r.language, r.chapter_count, r.file_path) for r in rows] == [("1", "Unknown", "en", 4, None)]
    assert N.read_documents(spark, str(tmp_path / "nowhere")).count() == 0


def test_snapshots_switch_and_repeat(spark, tmp_path):
    store = N.Snapshots(spark, str(tmp_path / "lib"))
    df = spark.createDataFrame([("a", 1)], "id string, n int")
    assert store.read(df.schema).count() == 0
    store.write(df)
    # The new version is made from the one being read.
    store.write(store.read(df.schema).unionByName(spark.createDataFrame([("b", 2)], df.schema)))
    assert sorted(r.id for r in store.read(df.schema).collect()) == ["a", "b"]
    other = N.Snapshots(spark, str(tmp_path / "lib"))
    other.write(other.read(df.schema).limit(1))
    with pytest.raises(StaleSnapshot):
        store.write(df)
    assert other.read(df.schema).count() == 1
    assert [other.at(v, df.schema).count() for v in other.log.versions()] == [1, 2, 1]


def _books(spark, per_volume):
    chapters = spark.createDataFrame([("n", i * 3, f"T & {i}", f"<p>body {i}</p>") for i in range(1, 8)],
                                     "novel_id string, chapter_index int, title string, html string")
    heads = spark.createDataFrame([("n", "Book", "en", "<h1>Book</h1>", [("title", "Book")])],
                                  "novel_id string, title string, language string, title_page string, record array<struct<key:string,value:string>>")
    return heads, B.with_volume(chapters, per_volume)


def test_archives_round_trip(spark):
    heads, chapters = _books(spark, None)
    packed = A.pack_books(heads, chapters)
    again = A.pack_books(heads, chapters.repartition(3))
    assert bytes(packed.first().payload) == bytes(again.first().payload)
    docs = A.explode_archives(packed.select(F.col("novel_id").alias("archive_id"), "payload")).orderBy("spine").collect()
    assert [d.file_name for d in docs] == ["text/title.xhtml"] + [f"text/chapter_{i:04d}.xhtml" for i in range(1, 8)]
    assert docs[1].toc_title == "T & 1" and '<h2 class="chapter-title">T &amp; 1</h2>\n<p>body 1</p>' in docs[1].html
    heads, chapters = _books(spark, 3)
    volumes = A.archive_names(A.pack_books(heads, chapters), heads.select("novel_id", "title")).orderBy("volume").collect()
    assert [(v.volume, v.chapter_count) for v in volumes] == [(0, 3), (1, 3), (2, 1)]
    assert [v.file_name for v in volumes][:2] == ["book.epub", "book.vol2.epub"]


def test_counts_skip_front_matter(spark):
    docs = spark.createDataFrame([(1, "text/Cover.xhtml"), (1, "c1.xhtml"), (1, "chapter_subtitle.xhtml"), (2, "nav.xhtml")],
                                 "archive_id int, file_name string")
    archives = spark.createDataFrame([(1,), (2,), (3,)], "archive_id int")
    assert {r.archive_id: r.chapters for r in B.count_chapters(archives, docs).collect()} == {1: 1, 2: 0, 3: 0}


def test_state_precedence(spark):
    rows = [("a", 1, "status", "stopping"), ("a", 2, "status", "running"), ("b", 1, "status", "stopping"), ("b", 2, "done", None),
            ("c", 1, "error", None), ("c", 2, "done", None), ("d", 1, "status", "paused"), ("e", 1, "metadata", None)]
    df = spark.createDataFrame(rows, "job_id string, seq long, type string, state string").withColumn("ts", F.timestamp_seconds("seq"))
    assert {r.job_id: r.state for r in E.job_states(df).collect()} == {
        "a": "stopping", "b": "stopped", "c": "error", "d": "paused", "e": "running"}

"""Convert, update and import from pages to results."""

import io
import zipfile
import base64
import json

from pyspark.sql import functions as F

from chapterloom.functions.urls import entry_id
from chapterloom.operators import naming
from chapterloom.plans import lifecycle as P
from chapterloom.sources import archives as A, sink, snapshots as S
from chapterloom.sources.pages import book_covers, media_type_of

ROOT_B = "https://freewebnovel.com/novel/b"
ROOT_A = "https://www.royalroad.com/fiction/7/tale"


def b_list(numbers, pages):
    links = "".join(f'<li><a href="/novel/b/chapter-{n}">Ch {n}</a></li>' for n in numbers)
    options = "".join(f"<option>{i}</option>" for i in range(pages))
    return (f'<meta property="og:novel:novel_name" content="Novel B"><ul class="ul-list5"><li><a href="/novel/b/chapter-99">new</a></li></ul>'
            f'<ul id="idData">{links}</ul><select id="indexselect">{options}</select>')


def b_chapter(n):
    return (f'<style>.z{{display:none}}</style><span class="chapter">Full {n}</span><div class="m-read"><div class="txt"><div>wrapper ad</div>'
            f'<div id="article"><p>Text {n}</p><p class="z">decoy</p><div class="reader-ad-skip">ad</div><!--x--></div></div></div>')


def a_novel(n):
    entries = json.dumps([{"id": i, "title": f"A{i}", "url": f"/fiction/7/tale/chapter/{i}"} for i in range(1, n + 1)])
    return (f'<div class="fic-title"><h1>Tale</h1></div><script>window.chapters = {entries};</script>')


def world(spark):
    pages = {ROOT_B: b_list(range(1, 41), 3), f"{ROOT_B}?page=2": b_list(range(41, 81), 3), f"{ROOT_B}?page=3": b_list(range(81, 86), 3),
             ROOT_A: a_novel(3), f"{ROOT_A}/chapter/1": '<div class="chapter-content"><p>A one</p></div>',
             f"{ROOT_A}/chapter/2": "<p>no container</p>", "https://freewebnovel.com/novel/empty": "<p>nothing</p>"}
    pages |= {f"{ROOT_B}/chapter-{n}": b_chapter(n) for n in range(1, 86)}
    return spark.createDataFrame(list(pages.items()), "url string, html string").repartition(3)


def test_convert(spark, tmp_path):
    asks = [(1, f"{ROOT_B}/chapter-3?x#y", 39, 0, None, ""), (2, f"{ROOT_A}/chapter/2", 0, 0, [], "pl"), (3, "https://other.test/x", 0, 0, None, None),
            (4, "ftp://x", 0, 0, None, None), (5, "https://freewebnovel.com/novel/empty", 0, 0, None, None),
            (6, "https://freewebnovel.com/novel/gone", 0, 0, None, None), (7, ROOT_B, 86, 0, None, None), (8, ROOT_B, 0, 0, [2, 84, 500], None)]
    requests = spark.createDataFrame(asks, "request_id int, url string, start int, end int, selected array<int>, language string")
    done = P.convert(world(spark), requests, cap=20)
    rejected = {r.request_id: r.detail.split(":")[0] for r in done.rejected.collect()}
    assert rejected == {3: "unsupported_site", 4: "invalid_url", 5: "parser_error", 6: "fetch_error", 7: "parser_error"}
    chapters = {}
    for r in sorted(done.chapters.collect(), key=lambda r: (r.request_id, r.chapter_index)):
        chapters.setdefault(r.request_id, []).append(r)
    assert [c.chapter_index for c in chapters[1]] == list(range(39, 59))
    assert (chapters[1][0].title, chapters[1][0].html) == ("Full 39", '<div id="article"><p>Text 39</p></div>')
    assert [(c.chapter_index, c.failed) for c in chapters[2]] == [(1, False), (2, True), (3, True)]
    assert [c.chapter_index for c in chapters[8]] == [2, 84]
    assert sorted((r.request_id, r.warning) for r in done.warnings.collect()) == [
        (1, "20 of 47 selected chapters kept"),
        (2, f"#2 A2: No chapter content at {ROOT_A}/chapter/2"),
        (2, f"#3 A3: Could not fetch {ROOT_A}/chapter/3"),
    ]
    meta = {r.request_id: (r.title, r.language, r.source_url) for r in done.metadata.collect()}
    assert meta == {1: ("Novel B", "en", ROOT_B), 2: ("Tale", "pl", ROOT_A), 8: ("Novel B", "en", ROOT_B)}

    packed = P.archives_of(done)
    books = done.metadata.select(F.col("request_id").alias("novel_id"), "title")
    named = A.archive_names(packed, books)
    arrivals = named.select(F.regexp_replace("file_name", r"\.epub$", "").alias("slug"), F.col("novel_id").cast("long").alias("arrival"))
    stems = naming.free_names(arrivals, spark.createDataFrame([("tale",)], "stem string"))
    final = named.drop("file_name").join(stems.select(F.col("arrival").alias("novel_id"), F.concat("stem", F.lit(".epub")).alias("file_name")), "novel_id")
    saved = {r.novel_id: r.saved_path for r in sink.save_archives(final, str(tmp_path / "out")).collect()}
    assert {k: v.rsplit("/", 1)[1] for k, v in saved.items()} == {1: "novel-b.epub", 2: "tale-2.epub", 8: "novel-b-2.epub"}
    with zipfile.ZipFile(saved[2]) as z:
        assert len([n for n in z.namelist() if "chapter_" in n]) == 3
    blocked = tmp_path / "file"
    blocked.write_text("x")
    assert [r.saved_path for r in sink.save_archives(final, str(blocked)).collect()] == [None] * 3

    files = spark.createDataFrame([(k, v) for k, v in saved.items()], "request_id int, file_path string")
    rows = P.library_of(done, files, F.lit("2025-01-01T00:00:00+00:00")).collect()
    assert sorted((r.parser, r.chapter_count) for r in rows) == [("freewebnovel", 58), ("freewebnovel", 84), ("royalroad", 3)]
    assert len({r.id for r in rows}) == 2


def test_update(spark):
    lib = spark.createDataFrame(
        [("b", ROOT_B, "B", True, 83, f"{ROOT_B}/chapter-83"), ("a", ROOT_A, "A", True, 1, "moved"), ("x", "https://other.test/x", "X", True, 1, None),
         ("n", ROOT_B, "N", False, 1, None), ("g", "https://freewebnovel.com/novel/gone", "G", True, 4, None)],
        "id string, source_url string, title string, has_file boolean, chapter_count int, last_chapter_url string")
    results, bodies = P.update_library(world(spark), lib)
    got = {r.id: (r.status, r.added_chapters, r.chapter_count, r.detail) for r in results.collect()}
    assert got == {
        "b": ("updated", 2, 85, None),
        "a": ("updated", 2, 3, f"chapter_list_shifted; #2 A2: No chapter content at {ROOT_A}/chapter/2; #3 A3: Could not fetch {ROOT_A}/chapter/3"),
        "x": ("error", 0, 1, "unsupported_site"),
        "n": ("no_file", 0, 1, "no_epub_on_disk"),
        "g": ("error", 0, 4, "fetch_error: https://freewebnovel.com/novel/gone"),
    }
    assert sorted((r.id, r.chapter_index) for r in bodies.collect()) == [("a", 2), ("a", 3), ("b", 84), ("b", 85)]


def _epub(names):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>')
        items = "".join(f'<item id="i{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(names))
        spine = "".join(f'<itemref idref="i{i}"/>' for i in range(len(names)))
        z.writestr("OEBPS/c.opf", f"<package><manifest>{items}</manifest><spine>{spine}</spine></package>")
        for n in names:
            z.writestr(f"OEBPS/{n}", "<html><body>x</body></html>")
    return base64.b64encode(box.getvalue()).decode()


def test_import(spark):
    novels = [(ROOT_B, "B", _epub(["Information.xhtml", "0001_a.xhtml", "0002_b.xhtml"])), ("https://nowhere.test/n", "", _epub(["1.xhtml"])),
              (ROOT_A, "A", base64.b64encode(b"PK\x03\x04not readable").decode()), (ROOT_B, "B again", _epub(["1.xhtml"]))]
    doc = json.dumps({"Library": [dict(zip(("LibStoryURL", "LibFilename", "LibEpub"), n)) for n in novels]}).encode()
    exports = spark.createDataFrame([(1, bytearray(doc))], "export_id int, content binary")
    empty = spark.createDataFrame([], "id string")
    rows = P.import_exports(exports, empty).orderBy("position").collect()
    assert [(r.title, r.status, r.chapter_count, r.parser, r.detail) for r in rows] == [
        ("B", "imported", 2, "freewebnovel", None), ("n", "imported", 1, "unknown", "unsupported_site"),
        ("A", "imported", 0, "royalroad", None), ("B again", "skipped", 0, "freewebnovel", None)]


def test_library_documents(spark):
    entry = {"id": "x", "source_url": "u", "parser": "p", "title": 'T "q" ł', "author": "Au", "language": "pl", "cover_url": None, "file_path": None,
             "chapter_count": 3, "last_chapter_url": None, "created_at": "a", "updated_at": "b"}
    rows = [(1, i, *{**entry, "id": f"x{i}"}.values()) for i in range(1500)]
    schema = "library_id int, position int, " + ", ".join(f"{k} {'int' if k == 'chapter_count' else 'string'}" for k in entry)
    lib = spark.createDataFrame(rows, schema)
    docs = S.library_documents(lib, ["library_id"])
    assert sorted(r.part for r in docs.collect()) == [0, 1]
    assert json.loads(docs.filter("part = 1").first().content)["version"] == 1
    back = S.library_entries(docs, ["library_id", "part"], F.col("content"))
    again = back.withColumn("position", (F.col("position") + F.col("part") * 1000).cast("int")).select(lib.columns)
    assert again.exceptAll(lib).count() == 0 and again.count() == 1500


def test_all_list_pages_are_read(spark):
    last = 405
    pages = {ROOT_B: b_list([1], last)} | {f"{ROOT_B}?page={n}": b_list([n], last) for n in range(2, last + 1)}
    crawled = spark.createDataFrame(list(pages.items()), "url string, html string")
    novels = spark.createDataFrame([("n", ROOT_B, "freewebnovel")], "novel_id string, source_url string, site string")
    told = P.crawl(crawled, novels)
    assert [r.chapter_index for r in told.catalog.orderBy("chapter_index").collect()] == list(range(1, last + 1))
    assert told.truncated.count() == 0
    cut = P.crawl(crawled, novels, max_pages=3)
    assert cut.catalog.count() == 3
    assert [tuple(r) for r in cut.truncated.collect()] == [("n", last, "list_truncated: 3 of 405 list pages")]
    requests = spark.createDataFrame([(1, ROOT_B, 0, 0, None, None)], "request_id int, url string, start int, end int, selected array<int>, language string")
    done = P.convert(crawled, requests, max_pages=2)
    assert done.chapters.count() == 2
    assert (1, None, "list_truncated: 2 of 405 list pages") in [tuple(r) for r in done.warnings.collect()]


LIBRARY = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.ENTRY_TYPE)


def entry(i, url, path):
    return (i, url, "p", "T", "A", "en", None, path, 1, None, "t", "t")


def test_import_into_a_library(spark, tmp_path):
    book = _epub(["Information.xhtml", "0001_a.xhtml", "0002_b.xhtml"])
    first = [(ROOT_B, "B", book), ("https://nowhere.test/n", "B", _epub(["1.xhtml"])), (ROOT_A, "Known", book), ("https://nowhere.test/x", "Taken", book)]
    second = [(ROOT_B, "B again", book), ("https://nowhere.test/z", "Stuck", book), ("https://nowhere.test/z", "Free", book), ("https://nowhere.test/z", "Late", book)]

    def document(novels):
        return bytearray(json.dumps({"Library": [dict(zip(("LibStoryURL", "LibFilename", "LibEpub"), n)) for n in novels]}).encode())

    exports = spark.createDataFrame([(1, document(first)), (2, document(second)), (3, bytearray(b"{broken"))], "export_id int, content binary")
    out = tmp_path / "out"
    (out / "stuck.epub" / "full").mkdir(parents=True)
    known = spark.createDataFrame([(ROOT_A,)], "u string").select(entry_id(F.col("u")).alias("i")).first().i
    library = spark.createDataFrame([entry(known, ROOT_A, "/books/b-2.epub")], LIBRARY)
    files = spark.createDataFrame([("/else/taken.epub",)], "file_path string")
    done = P.import_library(exports, library, str(out), F.lit("now"), files=files)
    got = {(r.export_id, r.position): (r.status, r.chapter_count, r.file_path and r.file_path.rsplit("/", 1)[1], r.detail) for r in done.results.collect()}
    assert got == {
        (1, 0): ("imported", 2, "b.epub", None), (1, 1): ("imported", 1, "b-3.epub", "unsupported_site"), (1, 2): ("skipped", 0, None, None),
        (1, 3): ("imported", 2, "taken-2.epub", "unsupported_site"), (2, 0): ("skipped", 0, None, None),
        (2, 1): ("error", 0, None, "write_failed"), (2, 2): ("imported", 2, "free.epub", "unsupported_site"), (2, 3): ("skipped", 0, None, None)}
    assert [tuple(r) for r in done.errors.collect()] == [(3, "import_error")]
    rows = {r.file_path.rsplit("/", 1)[1]: (r.title, r.parser, r.chapter_count) for r in done.library.collect()}
    assert rows == {"b-2.epub": ("T", "p", 1), "b.epub": ("B", "freewebnovel", 2), "b-3.epub": ("B", "unknown", 1),
                    "taken-2.epub": ("Taken", "unknown", 2), "free.epub": ("Free", "unknown", 2)}
    assert zipfile.is_zipfile(out / "b.epub") and zipfile.is_zipfile(out / "free.epub")
    # A folder that cannot be written: errors, and the library stays as it is.
    blocked = tmp_path / "file"
    blocked.write_text("x")
    lost = P.import_library(exports, library, str(blocked), F.lit("now"))
    assert {r.status for r in lost.results.collect()} == {"error", "skipped"} and lost.library.count() == 1
    none = P.import_library(exports.limit(0), library, str(out), F.lit("now"))
    assert none.results.count() == 0 and none.library.count() == 1 and none.errors.count() == 0


def test_deleted_entries_take_their_files_unless_shared(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = [(n, f"{n}.epub", bytearray(n.encode())) for n in ("a", "b", "stray")]
    sink.save_archives(spark.createDataFrame(rows, "n string, file_name string, payload binary"), out).count()
    library = spark.createDataFrame([("1", f"{out}/a.epub"), ("2", f"{out}/a.epub"), ("3", f"{out}/b.epub"), ("4", None), ("5", "/elsewhere/x.epub")], "id string, file_path string")
    store = S.Snapshots(spark, str(tmp_path / "lib"))
    store.write(library)

    def delete(ids, keep=1):
        wanted = spark.createDataFrame([(i,) for i in ids], "id string")
        return sorted(r.file_path.rsplit("/", 1)[1] for r in P.delete_from_library(store, wanted, out, library.schema, keep).filter("removed").collect())

    assert delete(["1", "3", "5"], keep=2) == ["stray.epub"]  # the snapshot before still names b
    assert delete(["4"]) == ["b.epub"]
    assert delete(["2"]) == ["a.epub"] and store.read(library.schema).count() == 0
    assert delete(["9"]) == []


def test_covers_go_into_their_books(spark):
    heads = spark.createDataFrame([(i, "T", "en", "<h1>T</h1>", [("title", "T")], u) for i, u in enumerate(["u0", "u1", None, "u3", "gone"])],
                                  "novel_id int, title string, language string, title_page string, record array<struct<key:string,value:string>>, cover_url string")
    images = spark.createDataFrame([("u0", bytearray(b"\x89PNG\r\n\x1a\n.."), None), ("u1", bytearray(b"RIFF....WEBP.."), "image/webp; q=1"), ("u3", bytearray(b"%PDF"), None)],
                                   "url string, content binary, sent string")
    typed = images.withColumn("content_type", F.coalesce("sent", media_type_of(F.col("content"))))
    chapters = spark.createDataFrame([(i, 1, 0, "c", "<p>x</p>") for i in range(5)], "novel_id int, position int, volume int, title string, html string")
    packed = A.pack_books(heads, chapters, book_covers(heads, typed))
    found = {}
    for r in packed.collect():
        with zipfile.ZipFile(io.BytesIO(r.payload)) as z:
            found[r.novel_id] = [(n, z.read(n)) for n in z.namelist() if "cover" in n]
            assert ("cover-image" in z.read("EPUB/content.opf").decode()) == bool(found[r.novel_id])
    assert found == {0: [("EPUB/cover.png", b"\x89PNG\r\n\x1a\n..")], 1: [("EPUB/cover.webp", b"RIFF....WEBP..")], 2: [], 3: [], 4: []}

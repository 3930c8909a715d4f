"""Appending to stored archives, and files of books: all of a job's or none."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from chapterloom.operators import library as L
from chapterloom.plans import lifecycle as P
from chapterloom.sources import archives as A, sink, splicing as S

from test_lifecycle import ROOT_A, ROOT_B, world


def foreign(chapters, nav=False, prefix="", data_descriptor=False):
    """An archive as other programs write it: an NCX, namespace prefixes, sizes behind the data."""
    box = io.BytesIO()
    p = prefix
    names = [f"ch_{n}.xhtml" for n in chapters] + (["text/chapter_0041.xhtml"] if chapters else [])

    class Stream(io.RawIOBase):  # a stream that cannot seek makes zipfile put the sizes behind the data
        def writable(self):
            return True

        def write(self, data):
            return box.write(bytes(data))

    with zipfile.ZipFile(Stream() if data_descriptor else box, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>')
        items = "".join(f'<{p}item id="chapter_{i:04d}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(names, 42))
        items += f'<{p}item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><{p}item id="pic" href="é.png" media-type="image/png"/>'
        spine = "".join(f'<{p}itemref idref="chapter_{i:04d}"/>' for i in range(42, 42 + len(names)))
        space = f' xmlns:{p[:-1]}="http://www.idpf.org/2007/opf"' if p else ' xmlns="http://www.idpf.org/2007/opf"'
        z.writestr("OEBPS/c.opf", f'<{p}package{space}><{p}metadata><dc:language xmlns:dc="d">fr</dc:language></{p}metadata><{p}manifest>{items}</{p}manifest><{p}spine>{spine}</{p}spine></{p}package>')
        points = "".join(f'<navPoint><navLabel><text>Title of {n}</text></navLabel><content src="{n}"/></navPoint>' for n in names[:1])
        z.writestr("OEBPS/toc.ncx", f"<ncx><navMap>{points}</navMap></ncx>")
        z.writestr("OEBPS/é.png", os.urandom(500))
        for n in names:
            z.writestr(f"OEBPS/{n}", f"<html><body>{n}</body></html>" * 30)
    return box.getvalue()


@pytest.mark.parametrize("prefix,data_descriptor", [("", False), ("opf:", False), ("", True)])
def test_append_to_an_archive_of_another_program(spark, prefix, data_descriptor):
    content = foreign([1, 2], prefix=prefix, data_descriptor=data_descriptor)
    archives = spark.createDataFrame([("a", bytearray(content))], "archive_id string, payload binary")
    fresh = spark.createDataFrame([("a", 2, "Second {p} <é>", "<p>2</p>"), ("a", 1, None, None)], "archive_id string, position int, title string, html string")
    made = S.append_to_archives(archives, fresh).first()
    assert (made.added, made.detail) == (2, None)
    with zipfile.ZipFile(io.BytesIO(made.payload)) as z, zipfile.ZipFile(io.BytesIO(content)) as old:
        assert z.testzip() is None and z.namelist()[0] == "mimetype"
        for name in old.namelist():
            if name not in ("OEBPS/c.opf", "OEBPS/toc.ncx"):
                assert z.read(name) == old.read(name) and z.getinfo(name).compress_size == old.getinfo(name).compress_size
        assert 'lang="fr"' in z.read("OEBPS/text/chapter_0043.xhtml").decode()
        assert len(set(z.namelist())) == len(z.namelist())
        package = A.read_package(z)
        assert z.read("OEBPS/toc.ncx").decode().count("<navPoint") == 3
    assert [d[1:] for d in package.documents] == [
        ("ch_1.xhtml", "Title of ch_1.xhtml"), ("ch_2.xhtml", "ch_2.xhtml"), ("text/chapter_0041.xhtml", "text/chapter_0041.xhtml"),
        ("text/chapter_0042.xhtml", "text/chapter_0042.xhtml"), ("text/chapter_0043.xhtml", "Second {p} <é>")]
    # Appending again goes on from there, and leaves no second contents list.
    again = S.append_to_archives(
        spark.createDataFrame([("a", made.payload)], "archive_id string, payload binary"), fresh.filter("position = 1")
    ).first()
    with zipfile.ZipFile(io.BytesIO(again.payload)) as z:
        assert [n for n in z.namelist() if "0044" in n] == ["OEBPS/text/chapter_0044.xhtml"] and z.namelist().count("OEBPS/contents.xhtml") == 1
        assert len(A.read_package(z).documents) == 6


def test_archives_that_cannot_be_appended_to(spark):
    good = foreign([])
    rows = [(1, bytearray(b"PK\x03\x04 no archive")), (2, bytearray(good)), (3, bytearray(good)), (4, None), (5, bytearray(good[:400] + bytes(40) + good[440:]))]
    archives = spark.createDataFrame(rows, "archive_id int, payload binary")
    fresh = spark.createDataFrame([(i, 1, "t", "<p>x</p>") for i in (1, 2, 4, 9)], "archive_id int, position int, title string, html string")
    got = {r.archive_id: (r.payload is not None, r.added, r.detail) for r in S.append_to_archives(archives, fresh).collect()}
    assert got == {1: (False, 0, "unreadable_archive"), 2: (True, 1, None), 4: (False, 0, "unreadable_archive"), 9: (False, 0, "epub_file_missing")}
    assert S.append_to_archives(archives, fresh.limit(0)).count() == 0


def test_long_directory():
    members = [S.deflated(f"m{i}", b"x") for i in range(70_000)]
    with zipfile.ZipFile(io.BytesIO(S.written(members))) as z:
        assert len(z.infolist()) == 70_000 and z.read("m69999") == b"x"


def test_update_of_a_library_rewrites_its_archives(spark):
    lib = spark.createDataFrame(
        [("b", ROOT_B, "B", True, 83, f"{ROOT_B}/chapter-83"), ("a", ROOT_A, "A", True, 1, None), ("full", ROOT_B, "F", True, 85, None)],
        "id string, source_url string, title string, has_file boolean, chapter_count int, last_chapter_url string")
    results, bodies = P.update_library(world(spark), lib)
    stored = spark.createDataFrame([("b", bytearray(foreign([1]))), ("a", bytearray(b"damaged")), ("full", bytearray(foreign([])))], "id string, payload binary")
    rewritten = P.rewritten_archives(stored, bodies)
    made = {r.id: r for r in rewritten.collect()}
    assert {k: (v.added, v.detail) for k, v in made.items()} == {"b": (2, None), "a": (0, "unreadable_archive")}
    docs = A._documents(made["b"].payload)
    assert [(d[1], d[2]) for d in docs[2:]] == [("text/chapter_0042.xhtml", "Full 84"), ("text/chapter_0043.xhtml", "Full 85")]
    assert "Text 85" in docs[-1][3] and "decoy" not in docs[-1][3]
    final = L.with_rewrites(results, rewritten, lib)
    assert {r.id: (r.status, r.added_chapters, r.chapter_count, r.detail) for r in final.collect()} == {
        "b": ("updated", 2, 85, None), "a": ("error", 0, 1, "unreadable_archive"), "full": ("up_to_date", 0, 85, None)}
    after = {r.id: (r.chapter_count, r.last_chapter_url) for r in L.apply_updates(lib.withColumn("updated_at", F.lit("t")), final, F.lit("now")).collect()}
    assert after == {"b": (85, f"{ROOT_B}/chapter-85"), "a": (1, None), "full": (85, None)}


def books(spark, n, names=None):
    rows = [(i, names[i] if names else f"b{i}.epub", bytearray(f"book {i}".encode())) for i in range(n)]
    return spark.createDataFrame(rows, "novel_id int, file_name string, payload binary").repartition(3)


def test_sink_writes_all_books(spark, tmp_path):
    folder = str(tmp_path / "out")
    saved = {r.novel_id: r.saved_path for r in sink.save_archives(books(spark, 20), folder).collect()}
    assert saved == {i: f"{folder}/b{i}.epub" for i in range(20)}
    assert all((tmp_path / "out" / f"b{i}.epub").read_bytes() == f"book {i}".encode() for i in range(20))
    assert not [n for n in os.listdir(folder) if n.startswith("_staged")]
    # A second job replaces files of the same names and keeps its own list.
    more = books(spark, 3).withColumn("payload", F.lit("new").cast("binary"))
    assert sink.save_archives(more, folder).filter("saved_path is null").count() == 0
    assert (tmp_path / "out" / "b1.epub").read_bytes() == b"new" and (tmp_path / "out" / "b9.epub").read_bytes() == b"book 9"


def test_book_that_cannot_be_written_has_no_path(spark, tmp_path):
    names = ["a.epub", "../up.epub", None, "x/y.epub", "long" * 100, "b.epub"]
    saved = {r.novel_id: r.saved_path is not None for r in sink.save_archives(books(spark, 6, names), str(tmp_path / "out")).collect()}
    assert saved == {0: True, 1: False, 2: False, 3: False, 4: False, 5: True}
    assert sorted(n for n in os.listdir(tmp_path / "out") if not n.startswith("_")) == ["a.epub", "b.epub"]
    assert os.listdir(tmp_path) == ["out"]


def test_failed_job_leaves_no_file(spark, tmp_path):
    folder = tmp_path / "out"
    sink.save_archives(books(spark, 1), str(folder))
    broken = books(spark, 30).withColumn("payload", F.when(F.col("novel_id") == 29, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="lost"):
        sink.save_archives(broken, str(folder)).collect()
    assert sorted(n for n in os.listdir(folder) if not n.startswith("_saved")) == ["b0.epub"]

"""No page, archive member or archive may end a job."""

import io
import zipfile

from chapterloom.plans import workloads  # noqa: F401
from chapterloom.sources import archives as A, exports as X
from chapterloom.sources.html_nodes import parse_nodes, with_nodes


def test_odd_declarations_are_comments(spark):
    for page in ("<p>a<![foo[x]]>b</p>", "<p>a</p><![ x", "<![endif]--><p>c", "<!DOCTYPE", "<!-", "<![CDATA[x", "&#xFFFFFFFF;", None):
        assert isinstance(parse_nodes(page), list)
    rows = parse_nodes("<p>a<![foo[x]]>b</p>")
    assert [r[7] for r in rows if r[4] == "tx"] == ["a", "b"] or [r[7] for r in rows if r[4] == "tx"][0] == "a"
    pages = spark.createDataFrame([(1, "<![ x"), (2, "<p>t</p>"), (3, None)], "page_id long, html string")
    assert {r.page_id: len([n for n in r.nodes if n.kind == "el"]) for r in with_nodes(pages).collect()} == {1: 0, 2: 1, 3: 0}


def _zip(members, damage=()):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as out:
        for name, text in members.items():
            out.writestr(name, text)
    data = bytearray(box.getvalue())
    for name in damage:
        data[out.getinfo(name).header_offset + 30 + len(name)] ^= 1
    return bytes(data)


def test_damaged_members_lose_only_themselves(spark):
    members = {"Library/3/LibStoryURL": "http://a", "Library/3/LibFilename": "f", "Library/x/LibEpub": "no", "Library/7/other": "o"}
    exports = spark.createDataFrame(
        [(1, _zip(members)), (2, _zip(members, ["Library/3/LibFilename"])), (3, b"PK\3\4 cut"), (4, b"")], "export_id long, content binary"
    )
    got = {(r.export_id, r.position): (r.url, r.file_name, r.payload_text) for r in X.parse_zip_exports(exports).collect()}
    assert got == {
        (1, 3): ("http://a", "f", None), (1, 7): (None, None, None), (2, 3): ("http://a", None, None), (2, 7): (None, None, None)
    }
    statuses = {(r.export_id, r.status) for r in X.zip_members(exports).collect()}
    assert statuses == {(1, "ok"), (2, "ok"), (2, "unreadable"), (3, "no_archive"), (4, "no_archive")}


def test_an_archive_is_read_whole_or_not_at_all(spark):
    box = "<container><rootfiles><rootfile full-path='p.opf'/></rootfiles></container>"
    opf = (
        "<package xmlns='http://www.idpf.org/2007/opf'><manifest>"
        + "".join(f"<item id='i{k}' href='c{k}.xhtml' media-type='application/xhtml+xml'/>" for k in (1, 2))
        + "</manifest><spine><itemref idref='i1'/><itemref idref='i2'/></spine></package>"
    )
    members = {"META-INF/container.xml": box, "p.opf": opf, "c1.xhtml": "<p>one</p>", "c2.xhtml": "<p>two</p>"}
    df = spark.createDataFrame([(1, _zip(members)), (2, _zip(members, ["c2.xhtml"]))], "archive_id long, payload binary")
    documents = A.explode_archives(df)
    assert sorted((r.archive_id, r.spine) for r in documents.collect()) == [(1, 1), (1, 2)]
    assert [r.archive_id for r in A.unreadable_archives(df, documents).collect()] == [2]


def test_python_gets_few_pages_at_once(spark, tmp_path):
    """Batches were as large as the session's setting let them be, here a whole task's rows."""
    from chapterloom.plans.fragments import page_nodes
    from chapterloom.session import PAGE_ROWS

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    rows = [(i, f"https://a.example.org/{i}", "<p>t</p>") for i in range(2 * PAGE_ROWS + 7)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    sizes = lambda batches: (b.from_pydict({"n": [b.num_rows]}) for b in batches)
    try:
        for given, most in (("10000", PAGE_ROWS), ("0", PAGE_ROWS), ("100", 100)):
            spark.conf.set(name, given)
            seen = [r.n for r in page_nodes(spark, str(tmp_path)).coalesce(1).select("page_id").mapInArrow(sizes, "n long").collect()]
            assert sum(seen) == len(rows) and max(seen) <= most
    finally:
        spark.conf.set(name, before)

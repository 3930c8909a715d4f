import random

from pyspark.sql import functions as F

from chapterloom.operators import catalog as K
from chapterloom.operators import metadata as M
from chapterloom.plans.site_rules import MAX_LIST_PAGES, SITE_A, SITE_B
from chapterloom.sources.html_nodes import with_nodes


def merge_model(pages):
    """pages: {page: [(title, url)]} -> merged list, read page by page."""
    seen, out = set(), []
    page = 1
    while pages.get(page):
        fresh = [e for e in pages[page] if e[1] not in seen]
        if not fresh:
            break
        seen |= {e[1] for e in fresh}
        out += fresh
        page += 1
    return out


def test_merge_against_a_loop(spark):
    rng = random.Random(3)
    novels, rows = {}, []
    for n in range(150):
        pages = {}
        for p in range(1, rng.randrange(2, 7)):
            if rng.random() < 0.12:
                continue
            pages[p] = [(f"t{rng.randrange(99)}", f"u{rng.randrange(4 + 6 * p)}") for _ in range(rng.randrange(1, 6))]
        novels[n] = pages
        rows += [(n, p, i + 1, t, u) for p, es in pages.items() for i, (t, u) in enumerate(es)]
    df = spark.createDataFrame(rows, "novel_id int, page int, pos int, title string, url string").repartition(3)
    got = {}
    for r in sorted(K.merge_pages(df).collect(), key=lambda r: (r.novel_id, r.chapter_index)):
        got.setdefault(r.novel_id, []).append((r.chapter_index, r.title, r.url))
    for n, pages in novels.items():
        want = [(i, *e) for i, e in enumerate(merge_model(pages), 1)]
        assert got.get(n, []) == want


def test_forty_forty_five(spark):
    sizes = {1: 40, 2: 40, 3: 5}
    rows = [(1, p, i + 1, "t", f"/c-{p}-{i}") for p, n in sizes.items() for i in range(n)]
    repeated = [(2, p, i + 1, "t", f"/c-{i}") for p in range(1, 6) for i in range(40)]
    df = spark.createDataFrame(rows + repeated, "novel_id int, page int, pos int, title string, url string")
    out = K.merge_pages(df)
    assert [r.chapter_index for r in out.filter("novel_id = 1").orderBy("chapter_index").collect()] == list(range(1, 86))
    assert out.filter("novel_id = 2").count() == 40
    assert {(r.page, r.found) for r in K.found_running(df).filter("novel_id = 1").collect()} == {(1, 40), (2, 80), (3, 85)}


NOVEL_A = """<html><head><meta property="og:title" content="Meta title"></head><body>
<div class="fic-title"><h1> The  Title </h1><h4>by <a href="/p/1">An Author</a></h4></div>
<div class="cover-art-container"><img src="/covers/nocover.png"></div>
<div class="description"><p>One.</p><p>Two &amp; three.</p></div>
<span class="tags"><a class="label fiction-tag" href="/t">Magic</a><a class="fiction-tag">Slow <b>burn</b></a></span>
<table id="chapters"><tbody><tr><td><a href="/fiction/1/s/chapter/1">One</a></td><td><a href="/d">d</a></td></tr>
<tr><td>no link</td></tr><tr><td><a href="/fiction/1/s/chapter/2"> </a></td></tr></tbody></table>
SCRIPT</body></html>"""
SCRIPT = """<script>window.chapters = [{"id":1,"title":" First ","url":"/fiction/1/s/chapter/1"},
{"id":2,"title":null,"url":"/fiction/1/s/chapter/2"},{"id":3,"title":"no url"},{"id":4,"title":"  ","url":"/x"}];</script>"""


def test_site_a(spark):
    pages = [(1, "https://www.royalroad.com/fiction/1/s/chapter/7?x#y", NOVEL_A.replace("SCRIPT", SCRIPT), "royalroad"),
             (2, "https://www.royalroad.com/fiction/1/s", NOVEL_A.replace("SCRIPT", ""), "royalroad")]
    df = spark.createDataFrame(pages, "page_id int, url string, html string, site string")
    nodes = with_nodes(df, drop_html=False)
    listed = K.list_entries_a(nodes, SITE_A)
    rows = K.explode_entries(listed, F.col("entries"), ["page_id", "source"], F.lit(SITE_A.list_base)).collect()
    got = {(r.page_id, r.source, r.pos): (r.title, r.url) for r in rows}
    base = "https://www.royalroad.com"
    assert got == {
        (1, "json", 1): ("First", f"{base}/fiction/1/s/chapter/1"),
        (1, "json", 2): ("Chapter 2", f"{base}/fiction/1/s/chapter/2"),
        (1, "json", 3): ("", f"{base}/x"),
        (2, "table", 1): ("One", f"{base}/fiction/1/s/chapter/1"),
        (2, "table", 2): ("Chapter 2", f"{base}/fiction/1/s/chapter/2"),
    }
    meta = M.novel_metadata(nodes.drop("html"), (SITE_A, SITE_B)).filter("page_id = 1").first()
    assert (meta.title, meta.author, meta.description) == ("The  Title", "An Author", "One. Two & three.")
    assert (meta.cover_url, meta.source_url, meta.tags) == (None, f"{base}/fiction/1/s", ["Magic", "Slowburn"])


NOVEL_B = """<html><head><meta property="og:novel:novel_name" content=" B title "><meta property="og:novel:genre" content="Fantasy, Action,,">
<meta property="og:image" content="/c.jpg"></head><body><h1 class="tit">other</h1>
<div class="m-book1"><div class="txt"><div class="item"><a href="/author/x">Writer X</a></div></div></div>
<div class="m-newest1"><ul class="ul-list5"><li><a href="/novel/b/chapter-99">latest</a></li></ul></div>
<div class="m-newest2"><ul class="ul-list5" id="idData"><li><a href="/novel/b/chapter-1" title="Chapter 1: x">short</a></li>
<li><a href="/novel/b/about">skip</a></li><li><a href="/novel/b/chapter-2"></a></li></ul></div>
<select id="indexselect"><option>1</option><option>2</option><option>3</option></select></body></html>"""


def test_site_b(spark):
    df = spark.createDataFrame([(1, "https://freewebnovel.com/novel/b/?page=2", NOVEL_B, "freewebnovel")],
                               "page_id int, url string, html string, site string")
    nodes = with_nodes(df)
    listed = K.list_entries_b(nodes, SITE_B)
    rows = K.explode_entries(listed, F.col("entries"), ["page_id"], F.lit("https://freewebnovel.com/novel/b")).collect()
    assert [(r.pos, r.title, r.url) for r in rows] == [
        (1, "Chapter 1: x", "https://freewebnovel.com/novel/b/chapter-1"),
        (2, "Chapter", "https://freewebnovel.com/novel/b/chapter-2"),
    ]
    assert nodes.select(K.toc_pages(F.col("nodes"), SITE_B.toc_pages)).first()[0] == 3
    assert MAX_LIST_PAGES == 400
    m = M.novel_metadata(nodes, (SITE_A, SITE_B)).first()
    assert (m.title, m.author, m.tags) == ("B title", "Writer X", ["Fantasy", "Action"])
    assert (m.source_url, m.cover_url, m.description) == (
        "https://freewebnovel.com/novel/b", "https://freewebnovel.com/c.jpg", "")


def test_long_lists_are_whole_unless_a_cut_is_asked_for(spark):
    entries = spark.range(450 * 3).select(
        F.lit("n").alias("novel_id"), (F.floor(F.col("id") / 3) + 1).cast("int").alias("page"),
        (F.col("id") % 3 + 1).cast("int").alias("pos"), F.lit("t").alias("title"), F.col("id").cast("string").alias("url"),
    )
    got = {r.chapter_index: r.url for r in K.merge_pages(entries).collect()}
    assert got == {i + 1: str(i) for i in range(1350)}
    assert K.merge_pages(entries, 400).count() == 1200 and K.truncated_lists(entries, 450).count() == 0
    assert [(r.pages, r.warning) for r in K.truncated_lists(entries, 400).collect()] == [
        (450, "list_truncated: 400 of 450 list pages")]


def test_selection(spark):
    cat = spark.createDataFrame([("n", i, f"t{i}", f"u{i}") for i in range(1, 11)],
                                "novel_id string, chapter_index int, title string, url string")
    asks = [("range", 3, 5, None), ("open", 8, None, None), ("zero", 0, 0, []), ("list", 1, 2, [9, 2, 2, 77]), ("none", 11, None, None)]
    req = spark.createDataFrame([(r, "n", a, b, s) for r, a, b, s in asks],
                                "request_id string, novel_id string, start int, end int, selected array<int>")
    sel = K.select_chapters(cat, req)
    got = {}
    for r in sel.collect():
        got.setdefault(r.request_id, set()).add(r.chapter_index)
    assert got == {"range": {3, 4, 5}, "open": {8, 9, 10}, "zero": set(range(1, 11)), "list": {2, 9}}
    assert [r.request_id for r in K.empty_selections(req, sel).collect()] == ["none"]
    assert K.cap_chapters(sel, 0).count() == sel.count()
    assert {r.request_id: r.warning for r in K.cap_warnings(sel, 4).collect()} == {
        "zero": "4 of 10 selected chapters kept"}


def test_preview_parts(spark):
    cat = spark.range(1, 2502).select(F.lit("n").alias("novel_id"), F.col("id").alias("chapter_index"),
                                      F.lit("t").alias("title"), F.col("id").cast("string").alias("url"))
    meta = spark.createDataFrame([("n", "T")], "novel_id string, title string")
    got = {r.part: (len(r.chapters), r.chapters[0].chapter_index) for r in K.preview(meta, cat, 5).collect()}
    assert got == {0: (1000, 1), 1: (1000, 1001), 2: (501, 2001)}

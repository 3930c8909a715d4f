import pytest
from pyspark.sql import functions as F

from chapterloom.functions import nodes as N
from chapterloom.operators import cleaning as C
from chapterloom.sources.html_nodes import with_nodes


def clean(spark, html, base=None, **kw):
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    base = F.lit(base) if base else None
    return C.sanitize_nodes(with_nodes(df), base, **kw).select("clean_html").first()[0]


CASES = [
    ("<p>Hi<script>x()</script></p>", "<p>Hi</p>"),
    ("<p>a <font color='red'>b</font> c</p>", "<p>a b c</p>"),
    ("<p class='x' id='k' onclick='y()'>t</p>", '<p id="k">t</p>'),
    ("<p>a</p><p style='display: none'>b</p><p hidden>c</p>", "<p>a</p>"),
    ("<style>.h{display:none} @media x { #z, p.q {visibility:hidden} }</style><p class='a h'>no</p><p id='z'>no</p><p>yes</p>", "<p>yes</p>"),
    ("<p>a</p><!-- <script src='ad.js'></script> --><p>b</p>", "<p>a</p><p>b</p>"),
    ("<p>a<img src='x.png'></p>", "<p>a</p>"),
    ("<div><br> <br>text<br></div>", "<div> text<br/></div>"),
    ("<p><br></p><p> </p><div><span></span></div>ok", "<p></p>ok"),
    ("<p>1 &lt; 2 &amp; 3</p>", "<p>1 &lt; 2 &amp; 3</p>"),
    ("<p>a<b>b<i>c</p>d", "<p>a<b>b<i>c</i></b></p>d"),
    ("<p style='font-size:0.9em'>gone</p>x", "x"),
    ("<center><br>x</center>", "x"),
    ("<b>y</b><br>x", "<b>y</b><br/>x"),
    ("<div><ins><p>ad</p></ins><br>z</div>", "<div>z</div>"),
    ("<td colspan='2' align='x'>t</td>", '<td colspan="2">t</td>'),
]


def test_sanitize_cases(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(CASES)], "page_id int, html string")
    got = {r[0]: r[1] for r in C.sanitize_nodes(with_nodes(df)).select("page_id", "clean_html").collect()}
    assert [got[i] for i in range(len(CASES))] == [want for _, want in CASES]


def test_links_and_images(spark):
    html = "<a href='../x?q=1' rel='n' title='t\"q'>l</a><img src='/i.png' alt=''>"
    assert clean(spark, html, "http://h.test/a/b/c") == (
        "<a href=\"http://h.test/a/x?q=1\" title='t\"q'>l</a>"
    )
    kept = clean(spark, html, "http://h.test/a/b/c", keep_images=True)
    assert kept.endswith('<img alt="" src="http://h.test/i.png"/>')


def test_chapter_statuses_and_priority(spark):
    pages = [
        (1, "<head><style>.decoy{display:none}</style></head><div class='wrap'><div id='article'><p>one</p>"
            "<p class='decoy'>x</p><div id='pf-1'>ad</div></div><div>junk</div></div>"),
        (2, "<p>nothing</p>"),
        (3, "<div id='article'><script>1</script></div>"),
        (4, "<div class='wrap'><p>fall back</p></div>"),
    ]
    df = with_nodes(spark.createDataFrame(pages, "page_id int, html string"))
    out = C.chapter_contents(
        df,
        containers=[N.path(N.el(id="article")), N.path(N.el("div", "wrap"))],
        titles=[F.lit("t")],
        ads=[N.el(attr="id", prefix="pf-")],
    )
    got = {r.page_id: (r.status, r.clean_text) for r in out.collect()}
    assert got == {1: ("ok", "one"), 2: ("no_content", ""), 3: ("empty_after_cleaning", ""), 4: ("ok", "fall back")}


def test_descendant_paths(spark):
    html = ("<div class='a'><p><a href='/author/1'>x</a></p></div><a href='/author/2'>y</a>"
            "<div class='a b'><span><div class='c'><a href='/author/3'>z</a></div></span></div>")
    df = with_nodes(spark.createDataFrame([(1, html)], "page_id int, html string"))
    a = N.el("a", attr="href", prefix="/author/")
    one = N.path(N.el("div", "a"), a)
    two = N.path(N.el("div", "b"), N.el("div", "c"), a)
    row = df.select(
        F.transform(N.matches(F.col("nodes"), one), lambda x: x["attrs"]["href"]).alias("one"),
        N.first_text(F.col("nodes"), [N.path(N.el("h1")), two, one]).alias("two"),
    ).first()
    assert row.one == ["/author/1", "/author/3"] and row.two == "z"


@pytest.mark.parametrize("n", [3000])
def test_long_malformed_page(spark, n):
    html = "<article>" + "<p><b>word<br>" * n + "</article>"
    df = with_nodes(spark.createDataFrame([(1, html)], "page_id int, html string"))
    assert C.sanitize_nodes(df).select(F.length("clean_text")).first()[0] == n * 5 - 1

"""Cleaning rules over the driver's pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nodes as N
from ..functions.nodes import el, path
from ..operators import cleaning as C
from .fragments import (
    ARTICLE, ARTICLE_SQL, LINKS_SQL, ROOT_SQL, VISIBLE_HTML, flat_sql, inject, page_nodes,
)
from .registry import query

AD_SQL = """'(?s)<div class="ad">.*?</div>'"""
NO_AD = f"regexp_replace({VISIBLE_HTML}, {AD_SQL}, ' ', 'g')"
AD_STEP = el("div", "ad")


def _text(df):
    return df.select("page_id", C.flat_text(F.col("nodes")).alias("text"))


@query("""SELECT page_id, unnest(['.ad-' || (page_id % 7), '#top', 'footer']) AS selector FROM pages
          UNION ALL SELECT page_id, 'hr' FROM pages WHERE page_id % 2 = 0""")
def css_hidden_rules(spark, d):
    css = F.concat(
        F.lit("<style>.ad-"), (F.col("page_id") % 7).cast("string"),
        F.lit("{ display : NONE } p.x, #top , a > b {visibility:hidden} @media print{ footer {font-size: 0} } i{color:red}</style>"),
        F.when(F.col("page_id") % 2 == 0, F.lit("<style>hr,.1bad{display:none}</style>")).otherwise(F.lit("")),
    )
    df = page_nodes(spark, d, inject("<head>", css))
    return C.css_hidden_rules(df, ["page_id"])


@query(f"SELECT page_id, {flat_sql(NO_AD)} AS text FROM pages")
def strip_hidden(spark, d):
    css = F.when(F.col("page_id") % 2 == 0, F.lit("<style>.ad{display:none}</style>")).otherwise(
        F.lit("<style>b.q, .ad , .zz {color:red;visibility : hidden}</style>")
    )
    # A style sheet inside an ad says nothing about the page.
    promo = F.lit('<article><div class="promo"><style>p{display:none}</style>buy</div>')
    html = F.when(F.col("page_id") % 3 == 0, F.replace(inject("<head>", css), F.lit("<article>"), promo)).otherwise(
        inject("<head>", css)
    )
    return _text(C.strip_hidden(page_nodes(spark, d, html), ads=[el("div", "promo")]))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '<!--')) + len(regexp_extract_all(html, '<!DOCTYPE')) AS removed FROM pages""")
def strip_comments(spark, d):
    df = page_nodes(spark, d).withColumn("before", F.size("nodes"))
    return C.strip_comments(df).select("page_id", (F.col("before") - F.size("nodes")).cast("long").alias("removed"))


@query(f"""SELECT page_id, {flat_sql(VISIBLE_HTML)} AS text,
                  len(regexp_extract_all({VISIBLE_HTML}, '<[a-zA-Z]')) AS elements FROM pages""")
def drop_tags(spark, d):
    forms = inject("<nav>", F.lit("<form><input name=q><b>no</b></form><svg><g>no</g></svg><noscript>no</noscript>"))
    df = C.drop_tags(page_nodes(spark, d, forms))
    elements = F.size(F.filter("nodes", lambda x: x["kind"] == "el")).cast("long")
    return df.select("page_id", C.flat_text(F.col("nodes")).alias("text"), elements.alias("elements"))


@query(f"SELECT page_id, {flat_sql(NO_AD)} AS text FROM pages")
def inline_hidden(spark, d):
    kind = F.col("page_id") % 3
    mark = (
        F.when(kind == 0, '<div class="ad" style="color:red;DISPLAY : none">')
        .when(kind == 1, '<div class="ad" hidden>')
        .otherwise('<div class="ad" style="font-size:0.9em">')
    )
    html = F.replace(F.col("html"), F.lit('<div class="ad">'), mark)
    return _text(C.drop_inline_hidden(page_nodes(spark, d, html)))


@query(f"SELECT page_id, {flat_sql(NO_AD)} AS text FROM pages")
def strip_ads(spark, d):
    html = inject("<article>", F.lit('<i id="pf-12">junk</i><em class="x reader-ad-skip">junk</em>'))
    ads = [AD_STEP, el(attr="id", prefix="pf-"), el(None, "reader-ad-skip")]
    return _text(C.strip_ads(page_nodes(spark, d, html), ads))


@query("SELECT page_id, len(regexp_extract_all(html, '<li>')) AS kept, 0 AS left_over FROM pages")
def image_policy(spark, d):
    df = page_nodes(spark, d, inject("<li>", F.lit('<img src="/i.png" alt="x">')))

    def images(nodes):
        return F.size(F.filter(nodes, lambda x: x["tag"] == "img")).cast("long")

    with_images = df.withColumn("kept", images(F.col("nodes")))
    return C.drop_images(with_images).select("page_id", "kept", images(F.col("nodes")).cast("int").alias("left_over"))


@query(f"""SELECT page_id, len(regexp_extract_all({VISIBLE_HTML}, '<(p|b|br|ul|li|a|div|h1)[ >]')) AS elements,
                  {flat_sql(VISIBLE_HTML)} AS text FROM pages""")
def unwrap_tags(spark, d):
    df = C.unwrap_tags(C.drop_tags(page_nodes(spark, d)))
    elements = F.size(F.filter("nodes", lambda x: x["kind"] == "el")).cast("long")
    return df.select("page_id", elements.alias("elements"), C.flat_text(F.col("nodes")).alias("text"))


@query(f"SELECT page_id, pos, {ROOT_SQL} || href AS href, 1 AS n_attrs FROM ({LINKS_SQL})")
def attr_allowlist(spark, d):
    html = F.replace(F.col("html"), F.lit('<a href="'), F.lit('<a class="k" onclick="x()" href="'))
    df = C.attr_allowlist(page_nodes(spark, d, html), F.col("url"))
    links = N.matches(F.col("nodes"), path(el("a")))
    rows = df.select("page_id", F.posexplode(links).alias("p", "a"))
    return rows.select(
        "page_id", (F.col("p") + 1).alias("pos"), F.col("a.attrs")["href"].alias("href"), F.size("a.attrs").alias("n_attrs")
    )


@query(r"""SELECT page_id, len(regexp_extract_all(html, '<p>')) - len(regexp_extract_all(html, '<p>\s*</p>')) AS paragraphs,
                  len(regexp_extract_all(html, '<br>')) + 1 AS breaks, len(regexp_extract_all(html, '<div')) + 1 AS blocks FROM pages""")
def drop_empty(spark, d):
    html = inject("<nav>", F.lit("<p> </p><div><span>&nbsp;</span></div><div><br> <br></div><br>"))
    df = C.drop_empty(C.strip_comments(page_nodes(spark, d, html)))

    def count(tag):
        return F.size(F.filter("nodes", lambda x: x["tag"] == tag)).cast("long")

    return df.select("page_id", count("p").alias("paragraphs"), count("br").alias("breaks"), count("div").alias("blocks"))


CONTAINERS = [path(el("div", "chapter-content")), ARTICLE]


@query(f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'div' ELSE 'article' END AS tag, {flat_sql(ARTICLE_SQL)} AS text FROM pages""")
def content_container(spark, d):
    inner = F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1)
    wrapped = F.concat(
        F.lit("<article>outer"), F.lit('<div class="chapter-content">'), inner, F.lit("</div>junk</article>")
    )
    moved = F.replace(F.col("html"), F.concat(F.lit("<article>"), inner, F.lit("</article>")), wrapped)
    html = F.when(F.col("page_id") % 3 == 0, moved).otherwise(F.col("html"))
    df = page_nodes(spark, d, html).withColumn("tag", N.first_of(F.col("nodes"), CONTAINERS)["tag"])
    kept = C.keep_container(df, CONTAINERS)
    return kept.select("page_id", "tag", C.flat_text(F.col("nodes")).alias("text"))


def _broken_pages():
    """Every fifth article emptied, every next one renamed."""
    kind = F.col("page_id") % 5
    return (
        F.when(kind == 0, F.regexp_replace("html", "(?s)<article>.*?</article>", "<article><script>x</script> </article>"))
        .when(kind == 1, F.replace(F.replace(F.col("html"), F.lit("<article>"), F.lit("<main>")), F.lit("</article>"), F.lit("</main>")))
        .otherwise(F.col("html"))
    )


@query(f"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'empty_after_cleaning' WHEN 1 THEN 'no_content' ELSE 'ok' END AS status,
                  CASE WHEN page_id % 5 IN (0, 1) THEN '' ELSE {flat_sql(ARTICLE_SQL)} END AS text FROM pages""")
def content_status(spark, d):
    df = C.chapter_contents(page_nodes(spark, d, _broken_pages()), containers=[ARTICLE], titles=[F.lit("")])
    return df.select("page_id", "status", F.col("clean_text").alias("text"))


@query(f"""SELECT page_id, coalesce(CASE WHEN page_id % 5 <> 0 THEN nullif({flat_sql("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}, '') END,
                  'Page ' || page_id) AS title FROM pages""")
def chapter_title(spark, d):
    catalog_title = F.concat(F.lit("Page "), F.col("page_id").cast("string"))
    page_title = N.first_text(F.col("nodes"), [path(el("h2", "none")), path(el("h1"))])
    df = C.chapter_contents(
        page_nodes(spark, d, _broken_pages()), containers=[ARTICLE], titles=[page_title, catalog_title]
    )
    return df.select("page_id", F.btrim(F.regexp_replace("title", r"\s+", " ")).alias("title"))


@query()
def sanitize_html(spark, d):
    df = C.chapter_contents(
        page_nodes(spark, d), containers=[ARTICLE], titles=[F.lit("")], ads=[AD_STEP], base_url=F.col("url")
    )
    return df.select("page_id", "status", "clean_html")


@query("""SELECT page_id, 'ok' AS status, '<h2 id="k">Turn ' || page_id || '</h2><p>A &lt;b&gt; &amp; ' || replace(url, '&', '&amp;') || '</p>'
                 || CASE WHEN page_id % 2 = 1 THEN '<p>shown</p>' ELSE '' END
                 || '<p>user <em>says</em> so</p><a href="https://e.example/c/' || page_id || '" title="t">link</a>'
                 || CASE WHEN page_id % 3 = 0 THEN '' ELSE '<blockquote><b>deep</b> <i>er</i></blockquote>' END
                 || '<ul><li>1</li><li>2</li></ul>' AS clean_html FROM pages""")
def sanitize_template(spark, d):
    """Every cleaning rule on one page, down to the exact markup."""
    number, kind = F.col("page_id").cast("string"), F.col("page_id")
    html = F.concat(
        F.lit("<html><head>"), F.when(kind % 2 == 0, "<style>.gone{display:none}</style>").otherwise(""),
        F.lit('</head><body><nav>menu</nav><article><br><h2 onclick="x()" id="k">Turn '), number,
        F.lit('</h2><!-- c --><p style="color:red" class="z">A &lt;b&gt; &amp; '), F.replace("url", F.lit("&"), F.lit("&amp;")),
        F.lit('</p><p class="gone">shown</p><p style="display: none">never</p><script>bad()</script><form>f</form>'),
        F.lit("<section><p>user <em>says</em> <font color=red>so</font></p></section><p> </p><div><b></b></div>"),
        F.lit('<img src="/i.png"><a href="/c/'), number, F.lit('" target=_blank title="t">link</a><div class="ad">buy</div>'),
        F.when(kind % 3 == 0, "<svg><g>no</g></svg>").otherwise("<blockquote><center><b>deep</b> <i>er</i></center></blockquote>"),
        F.lit("<ul><li>1</li><li>2</li></ul></article></body></html>"),
    )
    df = C.chapter_contents(
        page_nodes(spark, d, html), containers=[ARTICLE], titles=[F.lit("")], ads=[AD_STEP], base_url=F.lit("https://e.example/a/")
    )
    return df.select("page_id", "status", "clean_html")


@query(f"SELECT page_id, {flat_sql(ARTICLE_SQL)} AS text FROM pages")
def sanitized_text(spark, d):
    """The cleaned fragment, read again, still says what the page said."""
    from ..sources.html_nodes import with_nodes

    again = with_nodes(sanitize_html(spark, d).select("page_id", F.col("clean_html").alias("html")))
    return _text(again)

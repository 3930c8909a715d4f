"""Catalogs, selection and the fetch frontier over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nodes as N
from ..functions.nodes import el, path
from ..functions.urls import host
from ..operators import catalog as K
from ..operators.ordering import with_ordinal
from ..session import checkpointed
from ..sources.html_nodes import with_nodes
from ..sources.pages import spread, table
from .fragments import (
    HOST_SQL, LINKS_SQL, NAV, NAV_LINKS, ORDER_CATALOG, ROOT_SQL, inject, order_catalog, page_nodes,
)
from .registry import query
from .site_rules import SITE_A, SITE_B

_A = "https://www.royalroad.com"


def _script_page(broken):
    """Page text with its nav links also as an embedded script list."""
    nav = F.regexp_extract("html", "(?s)<nav>(.*?)</nav>", 1)
    pattern = F.lit('<a href="([^"]*)">([^<]*)</a>')
    hrefs, texts = F.regexp_extract_all(nav, pattern, F.lit(1)), F.regexp_extract_all(nav, pattern, F.lit(2))
    entries = F.transform(
        hrefs,
        lambda h, i: F.struct(
            i.alias("id"),
            F.when(i == 1, F.lit("")).when(i == 3, F.lit("  "))
            .otherwise(F.concat(F.lit(" "), F.get(texts, i))).alias("title"),
            F.when(i != 4, h).alias("url"),
        ),
    )
    closing = F.when(broken, F.lit(', {"id":9,"title":"odd ];","url":"/z"}];')).otherwise(F.lit("];"))
    script = F.concat(
        F.lit("<script>window.chapters = "), F.regexp_replace(F.to_json(entries), r"\]$", ""), closing, F.lit("</script>")
    )
    return inject("<head>", script)


_JSON_SQL = f"""
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS pos, url,
           CASE pos WHEN 2 THEN 'Chapter 2' WHEN 4 THEN '' ELSE raw_text END AS title
    FROM (SELECT page_id, pos, 'https://www.royalroad.com' || href AS url,
                 trim(texts) AS raw_text FROM (
            SELECT page_id, pos, href, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="([^"]*)">([^<]*)</a>', 2)[pos] AS texts
            FROM ({LINKS_SQL}))) WHERE pos <> 5
"""


@query(f"SELECT * FROM ({_JSON_SQL}) WHERE page_id % 10 <> 0")
def catalog_json(spark, d):
    pages = table(spark, d, "pages").select("page_id", _script_page(F.col("page_id") % 10 == 0).alias("html"))
    return K.explode_entries(pages, K.json_entries(F.col("html")), ["page_id"], F.lit(_A))


def _as_table(html):
    """Nav list turned into a chapter table with two links per row."""
    for old, new in (
        ("<ul>", '<table id="chapters"><thead><tr><td><a href="/head">h</a></td></tr></thead><tbody>'),
        ("</ul>", "</tbody></table>"),
        ("<li>", "<tr><td>"),
        ("</li>", '</td><td><a href="/date">2 days</a></td></tr>'),
    ):
        html = F.replace(html, F.lit(old), F.lit(new))
    return html


_TABLE_SQL = f"""SELECT page_id, pos, 'https://www.royalroad.com' || href AS url,
                        coalesce(nullif(text, ''), 'Chapter ' || pos) AS title FROM ({LINKS_SQL})"""


@query(_TABLE_SQL)
def catalog_table(spark, d):
    df = page_nodes(spark, d, _as_table(F.col("html")))
    return K.explode_entries(df, K.table_entries(F.col("nodes"), SITE_A.toc_rows), ["page_id"], F.lit(_A))


@query(f"""SELECT page_id, 'json' AS source, pos, title, url FROM ({_JSON_SQL}) WHERE page_id % 3 = 0
           UNION ALL SELECT page_id, 'table', pos, title, url FROM ({_TABLE_SQL}) WHERE page_id % 3 = 1
           UNION ALL SELECT page_id, 'none', NULL, NULL, NULL FROM pages WHERE page_id % 3 = 2""")
def catalog_fallback(spark, d):
    kind = F.col("page_id") % 3
    html = F.when(kind == 0, _script_page(F.lit(False))).when(kind == 1, _as_table(_script_page(F.lit(True)))).otherwise(F.col("html"))
    pages = spread(table(spark, d, "pages").select("page_id", "html")).withColumn("html", html)
    df = K.list_entries_a(with_nodes(pages, drop_html=False), SITE_A)
    found = K.explode_entries(df.filter("source <> 'none'"), F.col("entries"), ["page_id", "source"], F.lit(_A))
    missing = df.filter("source = 'none'").select(
        "page_id", "source", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("url"),
    )
    return found.unionByName(missing)


@query(f"""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS pos,
                  CASE WHEN pos % 3 = 0 THEN 'T' || pos ELSE coalesce(nullif(text, ''), 'Chapter') END AS title,
                  {ROOT_SQL} || '/chapter-' || pos AS url FROM ({LINKS_SQL}) WHERE page_id % 4 <> 0 AND pos % 4 <> 0""")
def catalog_links(spark, d):
    # Links 4, 8, ... lead elsewhere; every fourth page has an empty first container.
    html = F.col("html")
    nav = F.regexp_extract("html", "(?s)<nav>(.*?)</nav>", 1)
    parts = F.split(nav, '<a href="')
    rebuilt = F.array_join(
        F.transform(
            parts,
            lambda p, i: F.when(i == 0, p).when(i % 4 == 0, F.concat(F.lit('<a href="'), p)).otherwise(
                F.concat(
                    F.lit("<a "),
                    F.when(i % 3 == 0, F.concat(F.lit('title=" T'), i.cast("string"), F.lit('" '))).otherwise(F.lit("")),
                    F.lit('href="/chapter-'), i.cast("string"), F.lit('"'),
                    F.regexp_replace(p, '^[^"]*"', ""),
                )
            ),
        ),
        "",
    )
    box = F.when(F.col("page_id") % 4 == 0, F.lit('<div id="idData"></div><div class="m-newest2">')).otherwise(
        F.lit('<div class="m-newest2"><ul class="ul-list5"><li>none</li></ul></div><div id="idData">')
    )
    made = F.concat(box, F.replace(rebuilt, F.lit("<ul>"), F.lit('<ul class="ul-list5">')), F.lit("</div>"))
    html = F.replace(html, F.concat(F.lit("<nav>"), nav, F.lit("</nav>")), made)
    df = K.list_entries_b(page_nodes(spark, d, html), SITE_B)
    return K.explode_entries(df, F.col("entries"), ["page_id"], F.col("url"))


@query(f"""SELECT page_id, least(greatest(len(regexp_extract_all(html, '<li>')), 1), 400) AS list_pages FROM pages""")
def toc_pages(spark, d):
    html = F.col("html")
    for old, new in (("<ul>", '<select id="indexselect">'), ("<li>", "<option>"), ("</li>", "</option>"), ("</ul>", "</select>")):
        html = F.replace(html, F.lit(old), F.lit(new))
    pages = K.toc_pages(F.col("nodes"), SITE_B.toc_pages)
    return page_nodes(spark, d, html).select("page_id", pages.cast("long").alias("list_pages"))


def _list_pages(spark, d):
    """Hosts as novels: each of a host's pages is a list page, its nav links the entries."""
    df = page_nodes(spark, d).select(
        "page_id", host(F.col("url")).alias("novel_id"),
        F.transform(
            N.matches(F.col("nodes"), NAV_LINKS),
            lambda a: F.struct(N.text_of(N.inside(F.col("nodes"), a)).alias("title"), a["attrs"]["href"].alias("url")),
        ).alias("links"),
    )
    # Merging reads the entries several times: tokenise once, keep the narrow result.
    paged = with_ordinal(checkpointed(df), ["novel_id"], ["page_id"], "page")
    rows = paged.select("novel_id", "page", F.posexplode("links").alias("p", "l"))
    return rows.select("novel_id", "page", (F.col("p") + 1).alias("pos"), "l.title", "l.url")


_ENTRIES_SQL = f"""
    SELECT host AS novel_id, page, pos, text AS title, href AS url
    FROM (SELECT page_id AS pid, {HOST_SQL} AS host, row_number() OVER (PARTITION BY {HOST_SQL} ORDER BY page_id) AS page FROM pages) h
    JOIN ({LINKS_SQL}) l ON h.pid = l.page_id
"""
_FRESH_SQL = f"""
    SELECT * FROM (SELECT *, min(page) OVER (PARTITION BY novel_id, url) AS first_page FROM ({_ENTRIES_SQL})) WHERE page = first_page
"""
_STOP_SQL = f"""
    SELECT n.novel_id, min(n.page) AS stop FROM (
        SELECT DISTINCT novel_id, unnest(range(1, max_page + 2)) AS page FROM (SELECT novel_id, max(page) AS max_page FROM ({_ENTRIES_SQL}) GROUP BY novel_id)) n
    WHERE NOT EXISTS (SELECT 1 FROM ({_FRESH_SQL}) f WHERE f.novel_id = n.novel_id AND f.page = n.page) GROUP BY n.novel_id
"""


@query(f"""SELECT f.novel_id, title, url, row_number() OVER (PARTITION BY f.novel_id ORDER BY page, pos) AS chapter_index
           FROM ({_FRESH_SQL}) f JOIN ({_STOP_SQL}) s ON f.novel_id = s.novel_id WHERE page < stop""")
def catalog_merge(spark, d):
    return K.merge_pages(_list_pages(spark, d))


@query(f"""SELECT novel_id, page, size, sum(size) OVER (PARTITION BY novel_id ORDER BY page)::BIGINT AS found FROM (
             SELECT f.novel_id, page, count(*) AS size FROM ({_FRESH_SQL}) f JOIN ({_STOP_SQL}) s ON f.novel_id = s.novel_id
             WHERE page < stop GROUP BY f.novel_id, page)""")
def found_running(spark, d):
    return K.found_running(_list_pages(spark, d))


def _requests(spark, d):
    """One request per customer: a range, an explicit list, or everything."""
    c = table(spark, d, "customer")
    nation = F.col("c_nationkey").cast("int")
    listed = F.when(
        F.col("c_mktsegment") == "BUILDING", F.array(nation % 7 + 1, nation % 3 + 1, F.lit(9999))
    ).when(F.col("c_mktsegment") == "MACHINERY", F.array().cast("array<int>"))
    return c.select(
        F.col("c_custkey").alias("request_id"),
        F.col("c_custkey").alias("novel_id"),
        (nation % 4).alias("start"),
        F.when(F.col("c_acctbal") < 2000, F.lit(0)).when(F.col("c_acctbal") < 6000, nation).alias("end"),
        listed.alias("selected"),
    )


_SELECT_SQL = f"""
    SELECT c_custkey AS request_id, novel_id, chapter_index, title, url, c_mktsegment FROM customer JOIN ({ORDER_CATALOG}) ON c_custkey = novel_id
    WHERE CASE WHEN c_mktsegment = 'BUILDING' THEN chapter_index IN (c_nationkey % 7 + 1, c_nationkey % 3 + 1, 9999)
          ELSE chapter_index >= c_nationkey % 4 AND chapter_index <= CASE WHEN c_acctbal >= 2000 AND c_acctbal < 6000 AND c_nationkey > 0
               THEN c_nationkey ELSE 1000000000 END END
"""


def _selection(spark, d, requests=None):
    catalog = order_catalog(spark, d).select("novel_id", "chapter_index", "title", "url")
    return K.select_chapters(catalog, requests if requests is not None else _requests(spark, d))


@query(f"SELECT request_id, chapter_index, title, url FROM ({_SELECT_SQL}) WHERE c_mktsegment <> 'BUILDING'")
def select_range(spark, d):
    requests = _requests(spark, d).filter("coalesce(size(selected), 0) <= 0")
    return _selection(spark, d, requests).select("request_id", "chapter_index", "title", "url")


@query(f"SELECT request_id, chapter_index, title, url FROM ({_SELECT_SQL})")
def select_explicit(spark, d):
    return _selection(spark, d).select("request_id", "chapter_index", "title", "url")


@query(f"""SELECT request_id, chapter_index, CASE WHEN n > 6 THEN '6 of ' || n || ' selected chapters kept' END AS warning
           FROM (SELECT *, count(*) OVER (PARTITION BY request_id) AS n, row_number() OVER (PARTITION BY request_id ORDER BY chapter_index) AS rn
                 FROM ({_SELECT_SQL})) WHERE rn <= 6""")
def cap_chapters(spark, d):
    selection = _selection(spark, d)
    capped = K.cap_chapters(selection, 6)
    return capped.join(K.cap_warnings(selection, 6), "request_id", "left").select("request_id", "chapter_index", "warning")


@query(f"""SELECT c_custkey AS request_id, 'parser_error: The chapter selection is empty' AS detail FROM customer
           WHERE c_custkey NOT IN (SELECT request_id FROM ({_SELECT_SQL}))""")
def empty_selection(spark, d):
    return K.empty_selections(_requests(spark, d), _selection(spark, d)).select("request_id", "detail")


@query(f"""SELECT c_custkey AS novel_id, c_name AS title, 0 AS part, n, first_url, last_title, 100 AS max_chapters FROM customer JOIN (
             SELECT novel_id, count(*) AS n, min_by(url, chapter_index) AS first_url, max_by(title, chapter_index) AS last_title
             FROM ({ORDER_CATALOG}) GROUP BY novel_id) ON c_custkey = novel_id""")
def preview(spark, d):
    meta = table(spark, d, "customer").select(F.col("c_custkey").alias("novel_id"), F.col("c_name").alias("title"))
    shown = K.preview(meta, order_catalog(spark, d).select("novel_id", "chapter_index", "title", "url"), 100)
    return shown.select(
        "novel_id", "title", "part", F.size("chapters").cast("long").alias("n"),
        F.element_at("chapters", 1)["url"].alias("first_url"), F.element_at("chapters", -1)["title"].alias("last_title"),
        "max_chapters",
    )


@query(f"SELECT novel_id, least(count(*), 8) AS selected, count(*) AS chapters FROM ({ORDER_CATALOG}) GROUP BY novel_id")
def selected_count(spark, d):
    return K.selected_count(order_catalog(spark, d), 8)


_PRIORITY_HOST = "lower(o_orderpriority[1:1]) || '.example.org'"


@query(f"""SELECT url, host, place, (place - 1) * 0.75 AS wait_seconds FROM (
             SELECT url, host, row_number() OVER (PARTITION BY host ORDER BY novel_id, chapter_index, url) AS place FROM (
               SELECT url, {_PRIORITY_HOST} AS host, novel_id, chapter_index FROM (
                 SELECT *, 'https://' || {_PRIORITY_HOST} || '/c/' || o_orderkey AS url FROM ({ORDER_CATALOG.replace("AS url,", "AS old_url,")}))
               WHERE ordered_us >= 946684800000000))""")
def fetch_frontier(spark, d):
    c = order_catalog(spark, d)
    url = F.concat(F.lit("https://"), F.lower(F.substring("o_orderpriority", 1, 1)), F.lit(".example.org/c/"), F.col("o_orderkey").cast("string"))
    c = c.withColumn("url", url).select("novel_id", "chapter_index", "url", "ordered_us")
    held = c.filter(F.col("ordered_us") < 946684800000000)
    twice = c.unionByName(c)  # the same chapter may be listed more than once
    return K.fetch_frontier(twice.drop("ordered_us"), held).select("url", "host", "place", "wait_seconds")


@query("SELECT l_orderkey, l_linenumber, least(power(2, l_linenumber) * 0.5, 10) AS seconds FROM lineitem")
def retry_delay(spark, d):
    lines = table(spark, d, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", K.retry_delay(F.col("l_linenumber").cast("double")).alias("seconds"))


@query(f"SELECT page_id, count(*) AS links FROM ({LINKS_SQL}) GROUP BY page_id")
def nav_catalog(spark, d):
    entries = K.link_entries(F.col("nodes"), (NAV,), path(el("li"), el("a", attr="href")), "/")
    return page_nodes(spark, d).select("page_id", F.size(entries).cast("long").alias("links"))

"""Sources, URLs, routing and metadata over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nodes as N, urls
from ..functions.nodes import el, path
from ..functions.text import escape_markup, slugify, strip
from ..operators import metadata as M, routing as R
from ..sources.html_nodes import with_nodes
from ..sources.pages import cover_files, distinct_pages, spread, table
from .fragments import (
    ARTICLE, ARTICLE_SQL, HOST_SQL, LINKS_SQL, NAV_LINKS, NAV_SQL, ROOT_SQL, TEXTS_SQL,
    flat_sql, page_nodes,
)
from .registry import query
from .site_rules import SITE_A, SITE_B, Site, rules_table

NORM_SQL = "regexp_replace(split_part(url, '#', 1), '/+$', '')"

#: Sites for the page table's own hosts.
CORPUS = (
    Site("example", "Example", ("example.com",), url_prefix=r"^(https?://[^/]+/[a-z]+/\d+)"),
    Site("therou", "The Rou", ("m.therou.example.com",), priority=10, url_prefix=r"^(https?://[^/]+)"),
    Site("blogs", "Blogs", ("blog.ththan.example.net", "example.test"), priority=10),
)
RULES_SQL = """(VALUES ('example', 0, 'example.com'), ('therou', 10, 'm.therou.example.com'),
               ('blogs', 10, 'blog.ththan.example.net'), ('blogs', 10, 'example.test')) AS r(site, priority, domain)"""
ROUTED_SQL = f"""
    SELECT page_id, url, host, site FROM (
      SELECT page_id, url, host, site,
             row_number() OVER (PARTITION BY page_id ORDER BY priority DESC NULLS LAST, site) AS rn
      FROM (SELECT page_id, url, {HOST_SQL} AS host FROM pages) p
      LEFT JOIN {RULES_SQL} ON host = domain OR ends_with(host, '.' || domain)) WHERE rn = 1
"""


@query(f"""SELECT page_id, url, length(html) AS n FROM (
             SELECT *, row_number() OVER (PARTITION BY {NORM_SQL} ORDER BY page_id) AS rn FROM pages) WHERE rn = 1""")
def page_source(spark, d):
    pages = distinct_pages(table(spark, d, "pages"), urls.normalize(F.col("url")))
    return pages.select("page_id", "url", F.char_length("html").alias("n"))


@query("""SELECT doc_id, media_type, 'cover.' || CASE media_type WHEN 'image/png' THEN 'png'
                 WHEN 'image/webp' THEN 'webp' WHEN 'image/gif' THEN 'gif' ELSE 'jpg' END AS file_name
          FROM (SELECT doc_id, trim(split_part(CASE lang WHEN 'en' THEN 'image/png; charset=binary' WHEN 'fr' THEN 'image/webp'
                       WHEN 'de' THEN 'image/jpeg ;q=1' ELSE 'text/html' END, ';', 1)) AS media_type FROM documents)
          WHERE media_type LIKE 'image/%'""")
def cover_filter(spark, d):
    lang = F.col("lang")
    kind = (
        F.when(lang == "en", "image/png; charset=binary").when(lang == "fr", "image/webp")
        .when(lang == "de", "image/jpeg ;q=1").otherwise("text/html")
    )
    docs = table(spark, d, "documents").select("doc_id", kind.alias("content_type"))
    return cover_files(docs).select("doc_id", "media_type", "file_name")


@query(r"""SELECT page_id, trim(raw, E' \t\r\n') AS url,
                 CASE WHEN regexp_matches(trim(raw, E' \t\r\n'), '(?i)^https?://[^/?#:]') THEN 'ok' ELSE 'invalid_url' END AS detail
          FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN E'\t ' || url || E' \r\n' WHEN 1 THEN replace(url, 'http', 'ftp')
                       WHEN 2 THEN replace(url, '://', ':///') ELSE upper(url) END AS raw FROM pages)""")
def url_valid(spark, d):
    url, kind = F.col("url"), F.col("page_id") % 4
    raw = (
        F.when(kind == 0, F.concat(F.lit("\t "), url, F.lit(" \r\n")))
        .when(kind == 1, F.replace(url, F.lit("http"), F.lit("ftp")))
        .when(kind == 2, F.replace(url, F.lit("://"), F.lit(":///")))
        .otherwise(F.upper(url))
    )
    pages = table(spark, d, "pages").select("page_id", raw.alias("url"))
    good, bad = R.split_valid(pages)
    return good.withColumn("detail", F.lit("ok")).unionByName(bad.withColumn("url", strip(F.col("url"))))


@query(f"SELECT page_id, {HOST_SQL} AS host FROM pages")
def url_host(spark, d):
    return table(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"))


@query(f"SELECT page_id, host, coalesce(site, 'unsupported') AS site FROM ({ROUTED_SQL})")
def site_route(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    routed = R.route(pages, rules_table(spark, CORPUS))
    return routed.select("page_id", "host", F.coalesce("site", F.lit("unsupported")).alias("site"))


@query(f"""SELECT s.site, s.priority, coalesce(n, 0) AS pages
           FROM (SELECT DISTINCT site, priority FROM {RULES_SQL}) s
           LEFT JOIN (SELECT site, count(*) AS n FROM ({ROUTED_SQL}) GROUP BY site) c ON s.site = c.site""")
def site_list(spark, d):
    rules = rules_table(spark, CORPUS)
    routed = R.route(table(spark, d, "pages").select("page_id", "url"), rules)
    sizes = routed.groupBy("site").agg(F.count("*").alias("pages"))
    listed = R.list_sites(rules.join(sizes, "site", "left"))
    return listed.select("site", "priority", F.coalesce("pages", F.lit(0)).alias("pages"))


@query(f"""SELECT p.page_id, p.name, r.priority FROM (SELECT page_id, split_part({HOST_SQL}, '.', -2) AS name FROM pages) p
           LEFT JOIN (SELECT DISTINCT site, priority FROM {RULES_SQL}) r ON r.site = p.name""")
def site_lookup(spark, d):
    names = table(spark, d, "pages").select(
        "page_id", F.split_part(urls.host(F.col("url")), F.lit("."), F.lit(-2)).alias("site")
    )
    found = R.site_by_name(rules_table(spark, CORPUS), names)
    return found.select("page_id", F.col("site").alias("name"), "priority")


@query(f"SELECT page_id, {NORM_SQL} AS url FROM pages")
def url_norm(spark, d):
    return table(spark, d, "pages").select("page_id", urls.normalize(F.col("url")).alias("url"))


@query(f"""SELECT page_id, CASE WHEN site = 'example' AND regexp_matches(cut, '^https?://[^/]+/[a-z]+/[0-9]+')
                     THEN regexp_extract(cut, '^(https?://[^/]+/[a-z]+/[0-9]+)', 1)
                   WHEN site = 'therou' THEN regexp_extract(cut, '^(https?://[^/]+)', 1)
                   WHEN site = 'example' THEN cut ELSE {NORM_SQL} END AS url
           FROM (SELECT page_id, url, site, regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '/+$', '') AS cut
                 FROM ({ROUTED_SQL}))""")
def url_norm_site(spark, d):
    rules = rules_table(spark, CORPUS)
    routed = R.route(table(spark, d, "pages").select("page_id", "url"), rules)
    with_rule = routed.join(rules.select("site", "url_prefix"), "site", "left")
    return with_rule.select("page_id", urls.normalize_for_site(F.col("url"), F.col("url_prefix")).alias("url"))


@query(f"""SELECT page_id, pos, CASE pos % 6
                   WHEN 0 THEN {ROOT_SQL} || href
                   WHEN 1 THEN {ROOT_SQL} || parent || substr(href, 2)
                   WHEN 2 THEN {ROOT_SQL} || folder || substr(href, 2)
                   WHEN 3 THEN split_part(url, '://', 1) || '://other.example.org' || href
                   WHEN 4 THEN {ROOT_SQL} || path || '?q=' || pos
                   ELSE {ROOT_SQL} || path || coalesce('?' || query, '') || '#f' END AS url
           FROM (SELECT *, regexp_replace(path, '[^/]*$', '') AS folder,
                        regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]+/$', '') AS parent
                 FROM (SELECT page_id, pos, href, url, regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS path,
                              nullif(regexp_extract(url, '\\?([^#]*)', 1), '') AS query FROM ({LINKS_SQL})))""")
def link_resolve(spark, d):
    links = page_nodes(spark, d).select(
        "page_id", "url", F.posexplode(F.transform(N.matches(F.col("nodes"), NAV_LINKS), lambda a: a["attrs"]["href"]))
        .alias("p", "href")
    ).withColumn("pos", F.col("p") + 1)
    kind, tail = F.col("pos") % 6, F.substr("href", F.lit(2))
    link = (
        F.when(kind == 0, F.col("href"))
        .when(kind == 1, F.concat(F.lit("../"), tail))
        .when(kind == 2, F.concat(F.lit("./"), tail))
        .when(kind == 3, F.concat(F.lit("//other.example.org"), F.col("href")))
        .when(kind == 4, F.concat(F.lit("?q="), F.col("pos").cast("string")))
        .otherwise(F.lit("#f"))
    )
    return links.select("page_id", "pos", urls.resolve(F.col("url"), link).alias("url"))


@query("""SELECT page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
                 substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' ||
                 substr(h, 21, 12) AS id
          FROM (SELECT page_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS h FROM pages)""")
def entry_id(spark, d):
    return table(spark, d, "pages").select("page_id", urls.entry_id(F.col("url")).alias("id"))


SLUG_SQL = r"""coalesce(nullif(rtrim(substr(lower(trim(regexp_replace(regexp_replace(strip_accents(
    replace(replace(replace(text, 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe')), '[^\x00-\x7F]', '', 'g'),
    '[^A-Za-z0-9]+', '-', 'g'), '-')), 1, 80), '-'), ''), 'novel')"""


@query(f"SELECT doc_id, {SLUG_SQL} AS slug FROM documents", name="slugify")
def slugify_text(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", slugify(F.col("text")).alias("slug"))


@query(f"""SELECT page_id, coalesce(nullif(CASE WHEN page_id % 3 = 0 THEN '' ELSE {flat_sql("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} END, ''),
                  nullif({flat_sql("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, ''), 'Unknown title') AS title FROM pages""")
def first_match(spark, d):
    html = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", "(?s)<h1>.*?</h1>", "<h1> </h1>")).otherwise(F.col("html"))
    groups = [path(el("article"), el("h2")), path(el("article"), el("h1")), path(el("title"))]
    title = F.coalesce(N.first_text(F.col("nodes"), groups), F.lit("Unknown title"))
    one_line = F.btrim(F.regexp_replace(title, r"\s+", " "))
    return page_nodes(spark, d, html).select("page_id", one_line.alias("title"))


@query(f"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN {HOST_SQL} WHEN 1 THEN 'twitter ' || page_id END AS value FROM pages""")
def meta_lookup(spark, d):
    kind, number = F.col("page_id") % 3, F.col("page_id").cast("string")
    tags = F.concat(
        F.lit('<meta property="og:title" content="">'),
        F.when(kind == 0, F.concat(F.lit('<meta name="og:title" content="  '), urls.host(F.col("url")), F.lit(' ">')))
        .when(kind == 1, F.concat(F.lit('<meta itemprop="twitter:title" content="twitter '), number, F.lit('">')))
        .otherwise(F.lit("")),
        F.lit('<meta property="og:title" content="second tags never count">'),
    )
    html = F.replace(F.col("html"), F.lit("<title>"), F.concat(tags, F.lit("<title>")))
    value = N.meta(F.col("nodes"), ["og:title", "twitter:title"])
    return page_nodes(spark, d, html).select("page_id", value.alias("value"))


def _novel_page():
    """The page text with novel markup of site A (even ids) or site B (odd ids) put in."""
    number = F.col("page_id").cast("string")
    raw_title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    nav = F.regexp_extract("html", "(?s)<nav>(.*?)</nav>", 1)
    article = F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1)
    cover = F.when(F.col("page_id") % 4 == 0, F.lit("/img/nocover.png")).otherwise(F.concat(F.lit("../img/"), number, F.lit(".png")))
    tags = F.replace(nav, F.lit("<a href="), F.lit('<a class="x fiction-tag" href='))
    site_a = F.concat(
        F.lit('<h1 class="font-white">later</h1><div class="fic-title"><h1> '), raw_title,
        F.lit(' </h1><h4>by <a href="/p">'), urls.host(F.col("url")),
        F.lit('</a></h4></div><div class="cover-art-container"><img src="'), cover,
        F.lit('"></div><div class="description"><style>p{}</style>'), article,
        F.lit('</div><span class="tags">'), tags, F.lit("</span>"),
    )
    genres = F.array_join(F.regexp_extract_all(nav, F.lit('">([^<]*)</a>'), F.lit(1)), " , ")
    site_b = F.concat(
        F.lit('<meta property="og:novel:novel_name" content="'), urls.host(F.col("url")),
        F.lit(' novel"><meta name="og:image" content="/i/'), number, F.lit('.jpg">'),
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<meta property="og:novel:genre" content="'), F.regexp_replace(genres, '"', ""), F.lit(',,">')))
        .otherwise(F.lit("")),
        F.lit('<meta name="description" content=" short of it ">'),
        F.lit('<div class="m-book1"><div class="txt"><div class="item"><a href="/author/'), number,
        F.lit('">Writer '), number, F.lit('</a></div></div></div>'),
        F.lit('<ul>'), F.replace(nav, F.lit('<a href="/'), F.lit('<a href="/genre/')), F.lit('</ul>'),
    )
    even = F.col("page_id") % 2 == 0
    html = F.replace(F.col("html"), F.lit("<body>"), F.concat(F.lit("<body>"), F.when(even, site_a).otherwise(site_b)))
    url = F.when(even, F.concat(F.lit("https://www.royalroad.com/fiction/"), number, F.lit("/slug/chapter/9?x=1#c"))).otherwise(
        F.concat(F.lit("https://freewebnovel.com/novel/n-"), number, F.lit("/?page=3"))
    )
    return html, url


_TAGS_SQL = f"list_transform({TEXTS_SQL}, lambda t: trim(regexp_replace(t, '&amp;?', '&', 'g')))"
_META_SQL = f"""
    SELECT page_id,
      CASE WHEN page_id % 2 = 0 THEN coalesce(nullif({flat_sql("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, ''), 'later')
           ELSE {HOST_SQL} || ' novel' END AS title,
      CASE WHEN page_id % 2 = 0 THEN {HOST_SQL} ELSE 'Writer ' || page_id END AS author,
      CASE WHEN page_id % 2 = 0 THEN CASE WHEN length(body) > 2000 THEN rtrim(substr(body, 1, 2000)) || '…' ELSE body END
           ELSE 'short of it' END AS description,
      CASE WHEN page_id % 2 = 1 THEN 'https://freewebnovel.com/i/' || page_id || '.jpg'
           WHEN page_id % 4 = 0 THEN NULL
           ELSE 'https://www.royalroad.com/fiction/img/' || page_id || '.png' END AS cover_url,
      CASE WHEN page_id % 2 = 0 THEN 'https://www.royalroad.com/fiction/' || page_id || '/slug'
           ELSE 'https://freewebnovel.com/novel/n-' || page_id END AS source_url,
      array_to_string(list_filter(CASE WHEN page_id % 2 = 1 AND page_id % 3 = 0
             THEN list_transform(string_split(array_to_string(list_transform({_TAGS_SQL}, lambda t: replace(t, '"', '')), ','), ','), lambda t: trim(t))
             ELSE {_TAGS_SQL} END, lambda t: t <> ''), '|') AS tags,
      CASE WHEN page_id % 2 = 0 THEN 'RoyalRoad' ELSE 'FreeWebNovel' END AS publisher
    FROM (SELECT *, {flat_sql(ARTICLE_SQL)} AS body FROM pages)
"""


@query(_META_SQL)
def novel_metadata(spark, d):
    html, url = _novel_page()
    pages = spread(table(spark, d, "pages")).select("page_id", url.alias("url"), html.alias("html"))
    # Pages of other sites never reach the tokeniser, and no page text is shuffled.
    routed = pages.withColumn("site", R.site_of(F.col("url"), (SITE_A, SITE_B))).filter("site is not null")
    found = M.novel_metadata(with_nodes(routed), (SITE_A, SITE_B))
    one_line = F.btrim(F.regexp_replace("title", r"\s+", " "))
    return found.select(
        "page_id", one_line.alias("title"), "author", "description", "cover_url", "source_url",
        F.array_join("tags", "|").alias("tags"), "publisher",
    )


@query(r"""SELECT doc_id, len(tags) AS n, array_to_string(tags, '|') AS tags FROM (
             SELECT doc_id, list_filter(list_transform(string_split(text, ','), lambda t: regexp_replace(t, '^\s+|\s+$', '', 'g')), lambda t: t <> '') AS tags
             FROM documents)""")
def tags_split(spark, d):
    tags = M.split_tags(F.col("text"))
    return table(spark, d, "documents").select(
        "doc_id", F.size(tags).cast("long").alias("n"), F.array_join(tags, "|").alias("tags")
    )


@query("""SELECT d.doc_id, coalesce(nullif(CASE toxic WHEN 1 THEN 'pl' WHEN 0 THEN '' END, ''), lang) AS language
          FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def lang_override(spark, d):
    asked = table(spark, d, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, "pl").when(F.col("toxic") == 0, "").alias("requested")
    )
    docs = table(spark, d, "documents").select("doc_id", "lang").join(asked, "doc_id", "left")
    return docs.select("doc_id", M.override_language(F.col("requested"), F.col("lang")).alias("language"))


@query("""SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS digest
          FROM pages""", name="escape_markup")
def escape_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(escape_markup(F.col("html"))).alias("digest"))


@query("""SELECT event_id, detail, CASE WHEN starts_with(detail, 'unsupported_site') THEN 'error.unsupported_site'
                   WHEN starts_with(detail, 'parser_error') THEN 'error.parser_error'
                   WHEN starts_with(detail, 'fetch_error') THEN 'error.fetch_error'
                   WHEN starts_with(detail, 'stopped_empty') THEN 'error.stopped_empty' ELSE 'error.unknown' END AS message_key
          FROM (SELECT event_id, CASE event_type WHEN 'signup' THEN 'unsupported_site' WHEN 'click' THEN 'stopped_empty'
                       WHEN 'view' THEN 'parser_error: ' || props WHEN 'error' THEN 'fetch_error: ' || props
                       ELSE 'unknown_error: ValueError: ' || props END AS detail FROM events)""")
def error_class(spark, d):
    kind = F.col("event_type")
    failure = (
        F.when(kind == "signup", "UnsupportedSite").when(kind == "click", "StoppedBeforeStart")
        .when(kind == "view", "Parser").when(kind == "error", "Fetch").otherwise("ValueError")
    )
    events = table(spark, d, "events").select("event_id", R.error_detail(failure, F.col("props")).alias("detail"))
    return events.withColumn("message_key", R.error_key(F.col("detail")))


@query(f"SELECT page_id, {flat_sql(ARTICLE_SQL)} AS text FROM pages")
def html_to_text(spark, d):
    from ..operators.cleaning import flat_text

    nodes = F.col("nodes")
    return page_nodes(spark, d).select("page_id", flat_text(N.below(nodes, N.first(nodes, ARTICLE))).alias("text"))


@query(f"""SELECT page_id, len(regexp_extract_all({NAV_SQL}, '<a ')) AS links,
                  len(regexp_extract_all(regexp_replace(html, '(?s)<script>.*?</script>', '<script>', 'g'), '<[a-zA-Z]')) AS elements,
                  len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages""")
def html_nodes(spark, d):
    # Odd declarations, at the end of a page and cut off, are comments.
    kind = F.col("page_id") % 7
    tail = F.when(kind == 0, "<![odd[x]]>").when(kind == 1, "<![ x").otherwise("")
    html = F.concat(F.when(kind == 2, "<![if !IE]>").otherwise(""), "html", tail)
    nodes = page_nodes(spark, d, html).select("page_id", F.explode("nodes").alias("n")).select("page_id", "n.kind", "n.tag")
    return nodes.groupBy("page_id").agg(
        F.count_if(F.col("tag") == "a").alias("links"),
        F.count_if(F.col("kind") == "el").alias("elements"),
        F.count_if(F.col("tag") == "p").alias("paragraphs"),
    )

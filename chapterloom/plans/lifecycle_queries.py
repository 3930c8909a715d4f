"""The whole conversion over conversations served as a paginated novel site."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import checkpointed
from ..sources.pages import table
from . import lifecycle as P
from .registry import query
from .site_rules import SITE_B

PER_PAGE = 40
_ROOT = "https://freewebnovel.com/novel/c-"


def site_pages(spark, d):
    """List pages of forty links and one page per turn; some turns have no page."""
    c = table(spark, d, "conversations").select("conv_id", F.col("turn") + 1, "role", "text").toDF("conv", "n", "role", "text")
    root = F.concat(F.lit(_ROOT), F.col("conv").cast("string"))
    number = F.col("n").cast("string")
    link = F.concat(F.lit('<li><a href="/novel/c-'), F.col("conv").cast("string"), F.lit("/chapter-"), number, F.lit('">Turn '), number, F.lit("</a></li>"))
    # A list page holds forty links at most, however long the conversation.
    lists = c.groupBy("conv", (F.floor((F.col("n") - 1) / PER_PAGE) + 1).alias("page")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", link.alias("l")))), lambda x: x["l"]), "").alias("links")
    )
    pages = c.groupBy("conv").agg(F.ceil(F.max("n") / PER_PAGE).cast("int").alias("pages"))
    options = F.concat(F.lit('<select id="indexselect">'), F.repeat(F.lit("<option>p</option>"), F.col("pages")), F.lit("</select>"))
    shown = lists.join(pages, "conv").select(
        F.when(F.col("page") == 1, root).otherwise(F.concat(root, F.lit("?page="), F.col("page").cast("string"))).alias("url"),
        F.concat(F.lit('<meta property="og:novel:novel_name" content="Talk '), F.col("conv").cast("string"),
                 F.lit('"><ul id="idData">'), F.col("links"), F.lit("</ul>"), options).alias("html"),
    )
    text = F.col("text")
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    turns = c.filter((F.col("conv") + F.col("n")) % 11 != 0).select(
        F.concat(root, F.lit("/chapter-"), number).alias("url"),
        F.concat(F.lit('<span class="chapter">'), F.col("role"), F.lit(" "), number, F.lit('</span><div id="article"><p>'), text,
                 F.lit('</p><div class="comments-widget">ad</div><br></div>')).alias("html"),
    )
    return shown.unionByName(turns)


_CONVERTED = r"""
    SELECT request_id, chapter_index, missing OR blank AS failed,
      CASE WHEN missing OR blank THEN 'Turn ' || chapter_index ELSE role || ' ' || chapter_index END AS title,
      CASE WHEN missing OR blank THEN '<p><em>[chapterloom] No text was found for this chapter; it should be at <a href="' || url || '">' || url || '</a></em></p>'
           ELSE '<div id="article"><p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p><br/></div>' END AS html
    FROM (SELECT conv_id AS request_id, turn + 1 AS chapter_index, role, text, (conv_id + turn + 1) % 11 = 0 AS missing,
                 regexp_matches(text, '^\s*$') AS blank, 'https://freewebnovel.com/novel/c-' || conv_id || '/chapter-' || (turn + 1) AS url
          FROM conversations) WHERE chapter_index >= 2 AND chapter_index <= 13
"""


@query(_CONVERTED)
def convert_books(spark, d):
    requests = table(spark, d, "conversations").select("conv_id").distinct().select(
        F.col("conv_id").alias("request_id"),
        F.concat(F.lit(_ROOT), F.col("conv_id").cast("string"), F.lit("/chapter-1?x=1#top")).alias("url"),
        F.lit(2).alias("start"), F.lit(0).alias("end"), F.lit(None).cast("array<int>").alias("selected"),
        F.lit("").alias("language"),
    )
    # Pages are a stored table in earnest; here they are written once, then read like one.
    made = P.convert(checkpointed(site_pages(spark, d)), requests, (SITE_B,), cap=12)
    return made.chapters.select("request_id", "chapter_index", "failed", "title", "html")


@query(f"""WITH c AS (SELECT conv_id, turn + 1 AS n FROM conversations),
                p AS (SELECT conv_id, (n - 1) // {PER_PAGE} + 1 AS page, count(*) AS size FROM c GROUP BY ALL)
           SELECT conv_id AS request_id, 'Talk ' || conv_id AS title, (SELECT count(*) FROM c x WHERE x.conv_id = p.conv_id) AS chapters, page, size,
                  sum(size) OVER (PARTITION BY conv_id ORDER BY page) AS found, 12 AS max_chapters, NULL AS detail FROM p
           UNION ALL SELECT -1, NULL, NULL, NULL, NULL, NULL, NULL, 'invalid_url' UNION ALL SELECT -2, NULL, NULL, NULL, NULL, NULL, NULL, 'unsupported_site'""")
def preview_books(spark, d):
    """Requests for each conversation, one of no address and one of another site: catalogs, and chapters known after each list page."""
    known = table(spark, d, "conversations").select("conv_id").distinct().select(
        F.col("conv_id").alias("request_id"), F.concat(F.lit(_ROOT), F.col("conv_id").cast("string")).alias("url")
    )
    odd = known.limit(1).select(F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("request_id"), F.lit(u).alias("url")) for i, u in ((-1, "ftp://x"), (-2, "https://other.test/n"))])))
    told = P.preview(checkpointed(site_pages(spark, d)), known.union(odd), (SITE_B,), cap=12)
    sizes = told.metadata.groupBy("request_id", "title", "max_chapters").agg(F.sum(F.size("chapters")).alias("chapters"))
    pages = told.found.join(sizes, "request_id").select(
        "request_id", "title", "chapters", F.col("page").cast("long").alias("page"), "size", "found", F.col("max_chapters"), F.lit(None).cast("string").alias("detail")
    )
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in pages.schema.fields[1:-1]]
    return pages.unionByName(told.rejected.select("request_id", *empty, "detail"))

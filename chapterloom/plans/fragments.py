"""SQL and column pieces shared by the workloads and their checks.

The page table's own structure plays the sites: ``nav`` links are a catalog,
``div.ad`` an ad block, ``article`` the chapter container, and the host a novel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.nodes import el, path
from ..operators.ordering import MINUTE_US, with_ordinal
from ..session import page_batches
from ..sources.html_nodes import with_nodes
from ..sources.pages import spread, table

ARTICLE = path(el("article"))
NAV_LINKS = path(el("nav"), el("li"), el("a", attr="href"))
NAV = path(el("nav"))


def micros(ts: Column) -> Column:
    """Microseconds of a zone-less time stamp, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def page_nodes(spark: SparkSession, d: str, html: Column | None = None) -> DataFrame:
    """Pages with nodes, optionally of a changed page text."""
    page_batches(spark)
    pages = spread(table(spark, d, "pages").select("page_id", "url", "html"))
    return with_nodes(pages.withColumn("html", html) if html is not None else pages)


def order_catalog(spark: SparkSession, d: str) -> DataFrame:
    """orders as one long catalog: a customer is a novel, an order a chapter."""
    orders = table(spark, d, "orders").select(
        F.col("o_custkey").alias("novel_id"),
        micros(F.col("o_orderdate")).alias("ordered_us"),
        "o_orderkey",
        "o_orderpriority",
    )
    numbered = with_ordinal(orders, ["novel_id"], ["ordered_us", "o_orderkey"], "chapter_index", MINUTE_US)
    key = F.col("o_orderkey").cast("string")
    return numbered.select(
        "novel_id",
        "chapter_index",
        F.concat(F.lit("Order "), key).alias("title"),
        F.concat(F.lit("https://shop.example.org/c/"), key).alias("url"),
        "ordered_us",
        "o_orderkey",
        "o_orderpriority",
    )


ORDER_CATALOG = """
    SELECT o_custkey AS novel_id, 'Order ' || o_orderkey AS title,
           'https://shop.example.org/c/' || o_orderkey AS url, epoch_us(o_orderdate) AS ordered_us, o_orderkey, o_orderpriority,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS chapter_index
    FROM orders
"""


def conversation_chapters(spark: SparkSession, d: str) -> DataFrame:
    """conversations as novels: the turn is the chapter."""
    c = table(spark, d, "conversations")
    return c.select(
        F.col("conv_id").alias("novel_id"),
        (F.col("turn") + 1).alias("chapter_index"),
        F.concat("role", F.lit(" & "), F.col("turn").cast("string")).alias("title"),
        F.concat(F.lit("https://talk.example.org/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("url"),
        "text",
        "role",
    )


CONVERSATIONS = """
    SELECT conv_id AS novel_id, turn + 1 AS chapter_index, role || ' & ' || turn AS title,
           'https://talk.example.org/' || conv_id || '/' || turn AS url, text, role
    FROM conversations
"""


def job_events(spark: SparkSession, d: str) -> DataFrame:
    """events as a progress log: a user is a job, numbered by time.

    signup starts an update, view and error deliver a chapter, click is a
    control event and purchase ends the job.
    """
    kind = F.col("event_type")
    e = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("job_id"),
        "event_id",
        micros(F.col("ts")).alias("us"),
        F.when(kind == "signup", "update_started")
        .when(kind.isin("view", "error"), "chapter_downloaded")
        .when(kind == "click", "status")
        .otherwise("done")
        .alias("type"),
        (kind == "error").alias("failed"),
        F.floor("value").cast("long").alias("amount"),
    )
    numbered = with_ordinal(e, ["job_id"], ["us", "event_id"], "seq", MINUTE_US)
    state = F.when(F.col("type") == "status", F.when(F.col("amount") % 3 == 0, "paused").otherwise("running"))
    return numbered.select(
        "job_id", "seq", "event_id", "us",
        F.timestamp_micros("us").alias("ts"),
        "type", "failed", "amount",
        state.alias("state"),
        F.col("seq").alias("index"),
        (F.col("amount") + 100).alias("total"),
        F.col("amount").alias("new_chapters"),
    )


JOB_EVENTS = """
    SELECT *, CASE WHEN type = 'status' THEN CASE WHEN amount % 3 = 0 THEN 'paused' ELSE 'running' END END AS state,
           amount + 100 AS total
    FROM (
      SELECT CAST(user_id AS VARCHAR) AS job_id, event_id, epoch_us(ts) AS us,
             CASE WHEN event_type = 'signup' THEN 'update_started'
                  WHEN event_type IN ('view', 'error') THEN 'chapter_downloaded'
                  WHEN event_type = 'click' THEN 'status' ELSE 'done' END AS type,
             event_type = 'error' AS failed, CAST(floor(value) AS BIGINT) AS amount,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq
      FROM events)
"""


def flat_sql(x: str) -> str:
    """DuckDB: markup to one line of text."""
    plain = f"regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g')"
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·")):
        plain = f"replace({plain}, '{entity}', '{char}')"
    return f"trim(regexp_replace(regexp_replace({plain}, '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))"


#: DuckDB: the visible text of a page comes from here.
VISIBLE_HTML = r"regexp_replace(regexp_replace(html, '(?s)<(script|style)>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"
ARTICLE_SQL = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
HOST_SQL = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"
NAV_SQL = "regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1)"
HREFS_SQL = f"regexp_extract_all({NAV_SQL}, '<a href=\"([^\"]*)\">([^<]*)</a>', 1)"
TEXTS_SQL = f"regexp_extract_all({NAV_SQL}, '<a href=\"([^\"]*)\">([^<]*)</a>', 2)"
ROOT_SQL = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
#: DuckDB: one row per nav link.
LINKS_SQL = f"""
    SELECT page_id, url, html, hrefs[pos] AS href, regexp_replace(trim(texts[pos]), '&amp;?', '&', 'g') AS text, pos
    FROM (SELECT page_id, url, html, {HREFS_SQL} AS hrefs, {TEXTS_SQL} AS texts FROM pages),
         LATERAL (SELECT unnest(range(1, len(hrefs) + 1)) AS pos)
"""


def inject(after: str, piece: Column, html: Column | None = None) -> Column:
    """Page text with ``piece`` put behind a marker."""
    html = F.col("html") if html is None else html
    return F.replace(html, F.lit(after), F.concat(F.lit(after), piece))

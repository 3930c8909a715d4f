"""Chapter catalogs: extraction, merging of list pages, numbering, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import nodes as N
from ..functions.text import let, strip
from ..functions.urls import host, resolve
from ..plans.site_rules import CHAPTER_LINK, MAX_LIST_PAGES, Site
from .ordering import top_k, with_ordinal, with_running

# Fixed value: the chapter list embedded in a script.
CHAPTERS_SCRIPT = r"(?s)window\.chapters\s*=\s*(\[.*?\])\s*;"
#: Rows per array when a result must be delivered as arrays.
PART = 1000


def _numbered_titles(entries: Column, fallback: bool) -> Column:
    """Trim titles; an empty one becomes "Chapter n" before the trim if asked."""
    def named(e: Column, i: Column) -> Column:
        title = e["title"]
        if fallback:
            number = F.concat(F.lit("Chapter "), (i + 1).cast("string"))
            title = F.coalesce(F.nullif(title, F.lit("")), number)
        return F.struct(strip(title).alias("title"), e["href"].alias("href"))

    return F.transform(entries, named)


def json_entries(html: Column) -> Column:
    """Entries (title, href) of the embedded list; empty when absent or malformed."""
    raw = F.from_json(
        F.regexp_extract(html, CHAPTERS_SCRIPT, 1), "array<struct<title:string,url:string>>"
    )
    linked = F.filter(raw, lambda e: F.coalesce(e["url"] != "", F.lit(False)))
    entries = F.transform(linked, lambda e: F.struct(e["title"], e["url"].alias("href")))
    return F.coalesce(_numbered_titles(entries, True), F.array().cast("array<struct<title:string,href:string>>"))


def table_entries(nodes: Column, rows: N.Group) -> Column:
    """Entries from table rows: the first link of each row, one merged pass.

    Rows and links are sorted together by id; a row opens a slot and the first
    link inside it fills the slot.
    """
    def mark(x: Column, is_row: bool) -> Column:
        return F.struct(x["id"].alias("id"), x["last"].alias("last"), F.lit(is_row).alias("row"))

    opened = F.transform(N.matches(nodes, rows), lambda x: mark(x, True))
    links = F.transform(N.matches(nodes, N.path(N.el("a", attr="href"))), lambda x: mark(x, False))
    marks = F.sort_array(F.concat(opened, links))
    zero = F.struct(F.lit(0).alias("until"), F.array().cast("array<int>").alias("ids"))

    def visit(acc: Column, m: Column) -> Column:
        ids = acc["ids"]
        filled = F.struct(F.lit(0).alias("until"), F.array_append(ids, m["id"]).alias("ids"))
        return (
            F.when(m["row"], F.struct(m["last"].alias("until"), ids.alias("ids")))
            .when(acc["until"] >= m["id"], filled)
            .otherwise(acc)
        )

    ids = F.aggregate(marks, zero, visit, lambda acc: acc["ids"])
    entries = F.transform(ids, lambda i: let(F.get(nodes, i - 1), lambda a: _link_entry(nodes, a)))
    return _numbered_titles(entries, True)


def _link_entry(nodes: Column, link: Column) -> Column:
    return F.struct(
        N.text_of(N.inside(nodes, link)).alias("title"), link["attrs"]["href"].alias("href")
    )


def link_entries(
    nodes: Column, containers: tuple[N.Group, ...], links: N.Group, contains: str = CHAPTER_LINK
) -> Column:
    """Entries from links in the first container that exists, even if it is empty."""
    found = let(
        N.first_of(nodes, containers),
        lambda box: F.filter(
            N.matches(nodes, links),
            lambda a: (a["id"] > box["id"]) & (a["id"] <= box["last"]) & a["attrs"]["href"].contains(contains),
        ),
    )

    def entry(a: Column) -> Column:
        text = F.coalesce(F.nullif(a["attrs"]["title"], F.lit("")), N.text_of(N.inside(nodes, a)))
        title = F.coalesce(F.nullif(strip(text), F.lit("")), F.lit("Chapter"))
        return F.struct(title.alias("title"), a["attrs"]["href"].alias("href"))

    return F.coalesce(F.transform(found, entry), F.array().cast("array<struct<title:string,href:string>>"))


def explode_entries(df: DataFrame, entries: Column, keys: list[str], base: Column) -> DataFrame:
    """One row per entry: ``pos`` (1-based), ``title`` and the absolute ``url``."""
    rows = df.select(*keys, base.alias("_base"), F.posexplode(entries).alias("_p", "_e"))
    return rows.select(
        *keys,
        (F.col("_p") + 1).alias("pos"),
        F.col("_e.title").alias("title"),
        resolve(F.col("_base"), F.col("_e.href")).alias("url"),
    )


def list_entries_a(df: DataFrame, site: Site) -> DataFrame:
    """Append ``entries`` and ``source``: script first, table next, else none."""
    scripted = json_entries(F.col("html"))
    df = df.withColumn("_json", scripted).withColumn("_table", table_entries(F.col("nodes"), site.toc_rows))
    return (
        df.withColumn("entries", F.when(F.size("_json") > 0, F.col("_json")).otherwise(F.col("_table")))
        .withColumn(
            "source",
            F.when(F.size("_json") > 0, F.lit("json"))
            .when(F.size("_table") > 0, F.lit("table"))
            .otherwise(F.lit("none")),
        )
        .drop("_json", "_table")
    )


def list_entries_b(df: DataFrame, site: Site) -> DataFrame:
    links = N.path(N.el("li"), N.el("a", attr="href"))
    return df.withColumn("entries", link_entries(F.col("nodes"), site.toc_containers, links))


def toc_pages(nodes: Column, options: N.Group, most: int | None = MAX_LIST_PAGES) -> Column:
    """Announced number of list pages: at least one, at most ``most`` if that is not None."""
    return F.least(F.greatest(F.size(N.matches(nodes, options)), F.lit(1)), F.lit(most).cast("int"))


def _within(entries: DataFrame, max_pages: int | None) -> DataFrame:
    return entries if max_pages is None else entries.filter(F.col("page") <= max_pages)


def truncated_lists(entries: DataFrame, max_pages: int) -> DataFrame:
    """A warning (novel_id, pages, warning) for each novel with list pages beyond ``max_pages``."""
    return unread_pages(entries.groupBy("novel_id").agg(F.max("page").alias("pages")), max_pages)


def unread_pages(announced: DataFrame, max_pages: int) -> DataFrame:
    """The same from numbers of list pages (novel_id, pages)."""
    return announced.filter(F.col("pages") > max_pages).withColumn(
        "warning", F.concat(F.lit(f"list_truncated: {max_pages} of "), F.col("pages").cast("string"), F.lit(" list pages"))
    )


def fresh_pages(entries: DataFrame, max_pages: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries first seen on their page, kept pages with the count before them).

    A page counts while every page from the first on brought something new;
    the first stale, empty or missing page ends the list. All pages are read unless
    ``max_pages`` says otherwise; see ``truncated_lists`` for what that leaves out.
    """
    e = _within(entries, max_pages)
    first = e.groupBy("novel_id", "url").agg(F.min("page").alias("page"))
    fresh = e.join(first, ["novel_id", "url", "page"], "left_semi")
    sizes = fresh.groupBy("novel_id", "page").agg(F.count("*").alias("size"))
    kept = (
        with_running(sizes, ["novel_id"], ["page"], {"_rank": F.lit(1).cast("long"), "found": F.col("size")})
        .filter(F.col("_rank") == F.col("page"))
        .drop("_rank")
    )
    return fresh, kept


def merge_pages(entries: DataFrame, max_pages: int | None = None, start: int = 1) -> DataFrame:
    """List pages (novel_id, page, pos, title, url) to one numbered catalog."""
    fresh, kept = fresh_pages(entries, max_pages)
    at = F.row_number().over(W.partitionBy("novel_id", "page").orderBy("pos"))
    return (
        fresh.withColumn("_at", at)
        .join(kept, ["novel_id", "page"])
        .select(
            "novel_id",
            (F.col("found") - F.col("size") + F.col("_at") + (start - 1)).alias("chapter_index"),
            "title",
            "url",
        )
    )


def found_running(entries: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Chapters found so far, one row per list page that brought any."""
    return fresh_pages(entries, max_pages)[1].select("novel_id", "page", "size", "found")


def number_catalog(df: DataFrame, order: list[str]) -> DataFrame:
    """Number rows (novel_id, title, url, ...) within their novel."""
    return with_ordinal(df, ["novel_id"], order, "chapter_index")


def select_chapters(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """Chapters each request asks for: (request_id, novel_id, chapter_index, title, url).

    ``requests`` has request_id, novel_id, start, end and selected. A list wins
    over the range; zero, null and the empty list mean "not given".
    """
    listed = F.coalesce(F.size("selected"), F.lit(-1)) > 0
    wanted = (
        requests.filter(listed)
        .select("request_id", "novel_id", F.explode("selected").alias("chapter_index"))
        .distinct()
    )
    by_list = catalog.join(wanted, ["novel_id", "chapter_index"])
    ranges = requests.filter(~listed).select(
        "request_id",
        "novel_id",
        F.coalesce(F.nullif("start", F.lit(0)), F.lit(1)).alias("_from"),
        F.nullif("end", F.lit(0)).alias("_to"),
    )
    by_range = catalog.join(ranges, "novel_id").filter(
        (F.col("chapter_index") >= F.col("_from"))
        & (F.col("_to").isNull() | (F.col("chapter_index") <= F.col("_to")))
    )
    columns = ["request_id", "novel_id", "chapter_index", "title", "url"]
    return by_list.select(*columns).unionByName(by_range.select(*columns))


def cap_chapters(selection: DataFrame, cap: int) -> DataFrame:
    """First ``cap`` chapters of each request; zero means no limit."""
    if cap <= 0:
        return selection
    return top_k(selection, ["request_id"], [F.col("chapter_index")], cap, "_rank").drop("_rank")


def cap_warnings(selection: DataFrame, cap: int) -> DataFrame:
    """One warning per request that the cap shortened."""
    sizes = selection.groupBy("request_id").agg(F.count("*").alias("n"))
    over = F.lit(cap > 0) & (F.col("n") > cap)
    return sizes.filter(over).select(
        "request_id", F.format_string(f"{cap} of %d selected chapters kept", "n").alias("warning")
    )


def empty_selections(requests: DataFrame, selection: DataFrame) -> DataFrame:
    """Requests that select nothing: an error of their own."""
    return requests.join(selection, "request_id", "left_anti").withColumn(
        "detail", F.lit("parser_error: The chapter selection is empty")
    )


def preview(metadata: DataFrame, catalog: DataFrame, cap: int) -> DataFrame:
    """Metadata with the catalog as arrays of at most a thousand chapters.

    ``part`` counts the arrays of a novel from 0; ordinary novels have one, and
    no novel, however long, is gathered whole into one row.
    """
    parts = (
        catalog.withColumn("part", F.floor((F.col("chapter_index") - 1) / PART))
        .groupBy("novel_id", "part")
        .agg(F.sort_array(F.collect_list(F.struct("chapter_index", "title", "url"))).alias("chapters"))
    )
    return metadata.join(parts, "novel_id").withColumn("max_chapters", F.lit(cap))


def selected_count(catalog: DataFrame, cap: int) -> DataFrame:
    """Chapters ticked by default, per novel."""
    ticked = (F.col("chapter_index") <= cap) if cap > 0 else F.lit(True)
    return catalog.groupBy("novel_id").agg(F.count_if(ticked).alias("selected"), F.count("*").alias("chapters"))


def fetch_frontier(
    catalog: DataFrame, held: DataFrame, delay: float = 0.75
) -> DataFrame:
    """URLs still to be fetched, each once, with their earliest second per host."""
    missing = catalog.join(held.select("url"), "url", "left_anti")
    once = missing.groupBy("url").agg(
        F.min(F.struct("novel_id", "chapter_index")).alias("_f")
    ).select("url", host(F.col("url")).alias("host"), "_f.*")
    queued = with_ordinal(once, ["host"], ["novel_id", "chapter_index", "url"], "place")
    return queued.withColumn("wait_seconds", (F.col("place") - 1) * F.lit(delay))


def retry_delay(attempt: Column) -> Column:
    """Seconds before retry ``attempt``: doubling from half a second, at most ten."""
    return F.least(F.pow(F.lit(2.0), attempt) * 0.5, F.lit(10.0))

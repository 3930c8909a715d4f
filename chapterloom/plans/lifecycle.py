"""The three entry points as whole plans: convert, update all, import.

Input is a table of crawled pages (url, html) with one row per URL (see
``sources.pages.distinct_pages``); a page that is not there is a page that
could not be fetched. All requests, novels and chapters are handled
together by joins on URLs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import nodes as N
from ..functions.text import let, slugify
from ..functions.urls import entry_id, normalize_for_site
from ..operators import books as B, catalog as K, cleaning as C, imports as I, library as L, metadata as M, routing as R
from ..operators.naming import free_names
from ..operators.ordering import with_ordinal
from ..session import checkpointed
from ..sources.archives import explode_archives, pack_books
from ..sources.exports import parse_exports, unreadable_exports
from ..sources.html_nodes import with_nodes
from ..sources.pages import book_covers
from ..sources.sink import listed_files, remove_files, save_archives
from ..sources.snapshots import Snapshots
from ..sources.splicing import append_to_archives
from .site_rules import Site, SITES, rules_table


def by_site(sites: Sequence[Site], value: Callable[[Site], Column], site: str = "site") -> Column:
    """One CASE over the site name: every page is read once, whatever its site."""
    case = None
    for s in sites:
        hit = F.col(site) == s.name
        case = F.when(hit, value(s)) if case is None else case.when(hit, value(s))
    return case


@dataclass
class Crawl:
    """What the pages say about a set of novels."""

    metadata: DataFrame  # novel_id, title, author, ...
    catalog: DataFrame  # novel_id, site, chapter_index, title, url
    failures: DataFrame  # novel_id, detail
    truncated: DataFrame  # novel_id, pages, warning: lists of which ``max_pages`` left out pages
    entries: DataFrame  # novel_id, site, page, pos, title, url: the list pages' rows before they are merged


def _entries(site: Site) -> Column:
    empty = F.array().cast("array<struct<title:string,href:string>>")
    nodes = F.col("nodes")
    if site.toc_rows:
        scripted = K.json_entries(F.col("html"))
        return let(scripted, lambda e: F.when(F.size(e) > 0, e).otherwise(K.table_entries(nodes, site.toc_rows)))
    if site.toc_containers:
        return _linked(site)
    return empty


def _linked(site: Site) -> Column:
    links = N.path(N.el("li"), N.el("a", attr="href"))
    return K.link_entries(F.col("nodes"), site.toc_containers, links)


def _list_pages(site: Site) -> Column:
    return K.toc_pages(F.col("nodes"), site.toc_pages, None) if site.toc_pages else F.lit(1)


def route_novels(df: DataFrame, sites: Sequence[Site] = SITES, url: str = "url") -> DataFrame:
    """Append site, source_url and novel_id; unsupported URLs keep a null site."""
    routed = df.withColumn("site", R.site_of(F.col(url), sites))
    source = normalize_for_site(F.col(url), by_site(sites, lambda s: F.lit(s.url_prefix).cast("string")))
    return routed.withColumn("source_url", source).withColumn("novel_id", entry_id(F.col("source_url")))


def crawl(
    pages: DataFrame, novels: DataFrame, sites: Sequence[Site] = SITES, max_pages: int | None = None
) -> Crawl:
    """Metadata and catalogs of ``novels`` (novel_id, source_url, site), one row per novel.

    All list pages that a novel announces are read, at most ``max_pages`` if that is given; ``truncated`` then names the lists cut.
    """
    texts = pages.select(F.col("url").alias("page_url"), "html")
    front = novels.join(texts, novels["source_url"] == texts["page_url"]).drop("page_url")
    read = with_nodes(front, drop_html=False)
    fields = by_site(sites, lambda s: M.novel_fields(s, F.col("nodes"), F.col("source_url")))
    # Read by the metadata, the catalog and the further list pages: kept once, narrow.
    front = checkpointed(
        read.select(
            "novel_id", "source_url", "site",
            fields.alias("meta"),
            by_site(sites, _entries).alias("entries"),
            by_site(sites, _list_pages).alias("list_pages"),
        )
    )
    base = F.coalesce(by_site(sites, lambda s: F.lit(s.list_base).cast("string")), F.col("source_url"))
    keys = ["novel_id", "site", "page"]
    first = front.withColumn("page", F.lit(1)).withColumn("base", base)
    further = front.filter("list_pages > 1 and size(entries) > 0").select(
        "novel_id", "source_url", "site",
        F.explode(F.sequence(F.lit(2), F.least("list_pages", F.lit(max_pages).cast("int")))).alias("page"),
    )
    address = F.concat("source_url", F.lit("?page="), F.col("page").cast("string"))
    found = further.withColumn("_u", address).join(texts, F.col("_u") == F.col("page_url"))
    paged = [s for s in sites if s.toc_containers]
    more = with_nodes(found.select("novel_id", "source_url", "site", "page", "html")) if paged else None
    rows = K.explode_entries(first, F.col("entries"), keys, F.col("base"))
    if more is not None:
        rows = rows.unionByName(
            K.explode_entries(more, by_site(paged, _linked), keys, F.col("source_url"))
        )
    rows = checkpointed(rows)  # merging reads the entries several times
    merged = K.merge_pages(rows, max_pages)
    sites_of = novels.select("novel_id", "site")
    catalog = merged.join(sites_of, "novel_id")
    listed = front.select("novel_id", (F.size("entries") > 0).alias("_listed"))
    failures = (
        novels.select("novel_id", "source_url").join(listed, "novel_id", "left")
        .filter(~F.coalesce("_listed", F.lit(False)))
        .select(
            "novel_id",
            F.when(F.col("_listed").isNull(), F.concat(F.lit("fetch_error: "), "source_url"))
            .otherwise(F.lit("parser_error: Could not find the chapter list")).alias("detail"),
        )
    )
    announced = front.filter("size(entries) > 0").select("novel_id", F.col("list_pages").alias("pages"))
    truncated = K.unread_pages(announced if max_pages is not None else announced.limit(0), max_pages or 0)
    return Crawl(front.select("novel_id", "site", "meta.*"), catalog, failures, truncated, rows)


def chapter_bodies(pages: DataFrame, chapters: DataFrame, sites: Sequence[Site] = SITES) -> DataFrame:
    """Cleaned bodies of chapters (site, url), once per URL.

    A page without a title of its own has none here: catalogs may name one URL
    differently, and each selection falls back to its own.

    A URL without a page has status ``not_fetched``; statuses other than ``ok``
    carry a reason.
    """
    wanted = chapters.groupBy("url").agg(F.min("site").alias("site"))
    found = wanted.join(pages.select("url", "html"), "url")
    read = with_nodes(found, parsed="parsed")
    nodes = F.col("nodes")

    def ad(node: Column) -> Column:
        hit = F.lit(False)
        for s in sites:
            if s.ads:
                hit = hit | ((F.col("site") == s.name) & C.is_ad(node, s.ads))
        return hit

    clean = C.chapter_contents(
        read,
        containers=by_site(sites, lambda s: N.first_of(nodes, s.containers)),
        titles=[by_site(sites, lambda s: s.chapter_title.value(nodes)), F.lit(None).cast("string")],
        ads=ad,
        base_url=F.col("url"),
    ).select("url", "title", F.col("clean_html").alias("html"), "status")
    reason = (
        F.when(F.col("status") == "no_content", F.concat(F.lit("No chapter content at "), "url"))
        .when(F.col("status") == "empty_after_cleaning", F.concat(F.lit("Chapter "), "url", F.lit(" is empty after cleaning")))
        .when(F.col("status") == "parse_error", F.concat(F.lit("Unreadable page "), "url"))
        .when(F.col("status") == "not_fetched", F.concat(F.lit("Could not fetch "), "url"))
    )
    all_urls = wanted.select("url").join(clean, "url", "left")
    return all_urls.withColumn("status", F.coalesce("status", F.lit("not_fetched"))).withColumn("reason", reason)


@dataclass
class Preview:
    """What requests for a novel would find, before any chapter is read; keyed by ``request_id``."""

    metadata: DataFrame  # request_id, site, title, ..., part, chapters, max_chapters
    found: DataFrame  # request_id, page, size, found: chapters known after each list page
    rejected: DataFrame  # request_id, detail


def preview(pages: DataFrame, requests: DataFrame, sites: Sequence[Site] = SITES, cap: int = 0) -> Preview:
    """Requests (request_id, url) to metadata and catalogs, a novel read once however many ask for it."""
    valid, invalid = R.split_valid(requests)
    routed = checkpointed(route_novels(valid, sites).select("request_id", "novel_id", "source_url", "site"))
    supported = routed.filter("site is not null")
    novels = supported.groupBy("novel_id").agg(F.min("source_url").alias("source_url"), F.min("site").alias("site"))
    told = crawl(pages, novels, sites)
    asked = supported.select("request_id", "novel_id")
    shown = K.preview(told.metadata, told.catalog.drop("site"), cap)
    failed = asked.join(told.failures, "novel_id").select("request_id", "detail")
    rejected = (
        invalid.select("request_id", "detail")
        .unionByName(routed.filter("site is null").select("request_id", F.lit("unsupported_site").alias("detail")))
        .unionByName(failed)
    )
    return Preview(
        asked.join(shown, "novel_id").drop("novel_id"),
        asked.join(K.found_running(told.entries), "novel_id").drop("novel_id"),
        rejected,
    )


@dataclass
class Conversion:
    """Books made from requests; every table is keyed by ``request_id``."""

    metadata: DataFrame
    chapters: DataFrame  # request_id, chapter_index, title, html, failed
    warnings: DataFrame  # request_id, chapter_index (null: the cap, a list cut), warning
    rejected: DataFrame  # request_id, detail


def convert(
    pages: DataFrame, requests: DataFrame, sites: Sequence[Site] = SITES, cap: int = 0, max_pages: int | None = None
) -> Conversion:
    """Requests (request_id, url, start, end, selected, language) to books; a list cut at ``max_pages`` is a warning."""
    valid, invalid = R.split_valid(requests)
    routed = checkpointed(route_novels(valid, sites))
    supported = routed.filter("site is not null")
    novels = supported.groupBy("novel_id").agg(F.min("source_url").alias("source_url"), F.min("site").alias("site"))
    told = crawl(pages, novels, sites, max_pages)
    asked = supported.join(told.failures, "novel_id", "left_anti")
    selection = K.select_chapters(told.catalog.drop("site"), asked)
    empty = K.empty_selections(asked, selection)
    capped = K.cap_chapters(selection, cap)
    with_site = capped.join(novels.select("novel_id", "site"), "novel_id")
    bodies = chapter_bodies(pages, with_site, sites)
    contents = capped.select("request_id", "chapter_index", "url").join(bodies, "url")
    keyed = capped.select(F.col("request_id").alias("novel_id"), "chapter_index", "title", "url")
    placed = B.with_placeholders(
        keyed, contents.select(F.col("request_id").alias("novel_id"), "chapter_index", "title", "html", "status", "reason")
    )
    chapters = checkpointed(placed.withColumnRenamed("novel_id", "request_id"))
    meta = told.metadata.drop("site").join(asked.select("request_id", "novel_id", "site", F.col("language").alias("_asked")), "novel_id")
    meta = meta.withColumn("language", M.override_language(F.col("_asked"), F.col("language"))).drop("_asked")
    noted = chapters.filter("warning is not null").select("request_id", "chapter_index", "warning")
    limited = K.cap_warnings(selection, cap).select(
        "request_id", F.lit(None).cast(noted.schema["chapter_index"].dataType).alias("chapter_index"), "warning"
    )
    cut = asked.select("request_id", "novel_id").join(told.truncated, "novel_id").select(
        "request_id", F.lit(None).cast(noted.schema["chapter_index"].dataType).alias("chapter_index"), "warning"
    )
    failed = supported.select("request_id", "novel_id").join(told.failures, "novel_id").select("request_id", "detail")
    rejected = (
        invalid.select("request_id", "detail")
        .unionByName(routed.filter("site is null").select("request_id", F.lit("unsupported_site").alias("detail")))
        .unionByName(failed)
        .unionByName(empty.select("request_id", "detail"))
    )
    done = chapters.select("request_id").distinct()
    return Conversion(
        meta.join(done, "request_id", "left_semi"),
        chapters.select("request_id", "chapter_index", "title", "url", "html", "failed"),
        cut.unionByName(limited).unionByName(noted),
        rejected,
    )


def archives_of(result: Conversion, per_volume: int | None = None, images: DataFrame | None = None) -> DataFrame:
    """The archives of a conversion, keyed by ``novel_id`` = request; one a book unless volumes are asked for.

    ``images`` (url, content, content_type) are fetched covers.
    """
    meta = result.metadata.drop("novel_id").withColumnRenamed("request_id", "novel_id")
    pairs = F.array(F.struct("pos", "key", "value"))
    record = B.book_record(meta).groupBy("novel_id").agg(F.flatten(F.sort_array(F.collect_list(pairs))).alias("_p"))
    record = record.select(
        "novel_id",
        F.transform("_p", lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value"))).alias("record"),
    )
    page = B.title_page(F.col("title"), F.col("author"), F.col("description"), F.col("source_url"))
    heads = meta.withColumn("title_page", page).join(record, "novel_id")
    chapters = result.chapters.withColumnRenamed("request_id", "novel_id")
    covers = None if images is None else book_covers(meta, images)
    if per_volume is None:
        return pack_books(heads, B.in_one_volume(chapters), covers, numbered=False)
    return pack_books(heads, B.with_volume(chapters, per_volume), covers)


def library_of(result: Conversion, files: DataFrame, at: Column) -> DataFrame:
    """Library rows of a conversion; ``files`` has (request_id, file_path)."""
    key = F.col("request_id").alias("novel_id")
    meta = result.metadata.drop("novel_id").withColumnRenamed("request_id", "novel_id").withColumn("at", at)
    chapters = result.chapters.select(key, "chapter_index", "url")
    return L.record_conversions(meta, chapters, files.select(key, "file_path"))


def update_library(pages: DataFrame, library: DataFrame, sites: Sequence[Site] = SITES) -> tuple[DataFrame, DataFrame]:
    """(update results, bodies of the new chapters) for every entry at once.

    ``library`` has id, source_url, title, has_file, chapter_count and
    last_chapter_url. Only chapters past the stored count are cleaned.
    """
    with_file = library.filter("has_file")
    routed = checkpointed(
        route_novels(with_file.select("id", F.col("source_url").alias("url")), sites).select("id", "novel_id", "source_url", "site")
    )
    supported = routed.filter("site is not null")
    novels = supported.groupBy("novel_id").agg(F.min("source_url").alias("source_url"), F.min("site").alias("site"))
    told = crawl(pages, novels, sites)
    catalog = told.catalog.join(supported.select("id", "novel_id"), "novel_id").drop("novel_id")
    fresh = L.new_chapters(with_file, catalog)
    bodies = fresh.join(chapter_bodies(pages, fresh, sites).withColumnRenamed("title", "page_title"), "url")
    outcomes = bodies.select("id", "chapter_index", (F.col("status") != "ok").alias("failed"), "reason")
    errors = routed.filter("site is null").select("id", F.lit("unsupported_site").alias("detail")).unionByName(
        supported.join(told.failures, "novel_id").select("id", "detail")
    )
    return L.update_all(library, catalog.drop("site"), outcomes, errors), bodies


def rewritten_archives(archives: DataFrame, bodies: DataFrame) -> DataFrame:
    """Stored archives (id, payload) with the new chapters of an update behind the old ones: id, payload, added, detail.

    Only entries with new chapters are read and rewritten. A chapter that could not be fetched is a note in its place.
    """
    key = F.col("id").alias("novel_id")
    selection = bodies.select(key, "chapter_index", "title", "url")
    contents = bodies.select(key, "chapter_index", F.col("page_title").alias("title"), "html", "status", "reason")
    # Numbered without the bodies, which are shuffled once, with their archives.
    places = B.with_position(bodies.select(key, "chapter_index"))
    placed = B.with_placeholders(selection, contents).join(places, ["novel_id", "chapter_index"])
    made = append_to_archives(
        archives.select(F.col("id").alias("archive_id"), "payload"),
        placed.select(F.col("novel_id").alias("archive_id"), "position", "title", "html"),
    )
    return made.withColumnRenamed("archive_id", "id")


def delete_from_library(store: Snapshots, ids: DataFrame, folder: str, schema: T.StructType, keep: int = 1) -> DataFrame:
    """Entries out of the stored library, then out of ``folder`` the files that none of its last ``keep`` snapshots names.

    The snapshot comes first: a job that is lost in between leaves files too many, which the next call removes. Gives
    (file_path, removed).
    """
    remaining, _ = L.delete_entries(store.read(schema), ids)
    store.write(remaining)
    live = None
    for version in store.log.versions()[-keep:]:
        rows = store.at(version, schema).select("file_path")
        live = rows if live is None else live.union(rows)
    return checkpointed(remove_files(L.unreferenced_files(listed_files(store.spark, folder), live, folder)))


def import_exports(exports: DataFrame, library: DataFrame, sites: Sequence[Site] = SITES) -> DataFrame:
    """Exports (export_id, content) to results with chapter counts; known novels stay untouched."""
    rows = checkpointed(I.build_rows(parse_exports(exports)))
    results = I.import_results(I.mark_skips(rows, library), rules_table(exports.sparkSession, tuple(sites)))
    key = F.concat_ws("/", F.col("export_id").cast("string"), F.col("position").cast("string"))
    packed = rows.select(key.alias("archive_id"), "payload")
    counted = B.count_chapters(packed, explode_archives(packed))
    return results.withColumn("archive_id", key).join(counted, "archive_id", "left").withColumn(
        "chapter_count", F.when(F.col("status") == "imported", F.col("chapters")).otherwise(F.lit(0))
    ).drop("archive_id", "chapters")


@dataclass
class Import:
    """A library import from exports to files and entries."""

    results: DataFrame  # export_id, position, id, source_url, title, status, parser, detail, chapter_count, file_path
    library: DataFrame  # the entries after the import
    errors: DataFrame  # export_id, detail: exports without a readable novel


def import_library(
    exports: DataFrame, library: DataFrame, folder: str, at: Column, sites: Sequence[Site] = SITES, files: DataFrame | None = None
) -> Import:
    """Exports (export_id, content) into one library, in order of export_id and position.

    Each novel that the library does not know is written under a free name into ``folder`` and becomes an entry. If its file
    cannot be written the row is an error, and a later copy of the novel is tried instead: a round of writing for each
    such failure of a novel, one round if there is none. ``files`` (file_path) lists files whose names are taken
    beside those of the library.
    """
    spark = exports.sparkSession
    rows = checkpointed(I.build_rows(parse_exports(exports)))
    place = F.struct("export_id", "position")
    # All exports are one sequence: the place in it is the position.
    sequence = rows.select(place.alias("position"), F.lit(0).alias("export_id"), "source_url", "title")
    order = with_ordinal(rows.select("export_id", "position"), [], ["export_id", "position"], "arrival").select(place.alias("position"), "arrival")
    taken = library.select("file_path") if files is None else library.select("file_path").union(files.select("file_path"))
    stems = taken.select(F.regexp_extract("file_path", r"([^/]*)\.epub$", 1).alias("stem")).filter("stem <> ''")
    kind = sequence.schema["position"].dataType.simpleString()
    written = spark.createDataFrame([], f"position {kind}, stem string, saved_path string")
    while True:
        failed = written.filter("saved_path is null").select(F.lit(0).alias("export_id"), "position")
        marked = I.mark_skips(sequence, library, failed)
        open_rows = marked.filter("not skip and not failed").join(written.select("position"), "position", "left_anti")
        wanted = checkpointed(open_rows.select("position", "title").join(order, "position").withColumn("slug", slugify(F.col("title"))))
        if wanted.isEmpty():
            break
        names = free_names(wanted.select("slug", "arrival"), stems.union(written.filter("saved_path is not null").select("stem")))
        named = wanted.join(names.select("arrival", "stem"), "arrival").select("position", "stem", F.concat("stem", F.lit(".epub")).alias("file_name"))
        payloads = rows.select(place.alias("position"), "payload")
        saved = save_archives(named.join(payloads, "position"), folder)
        written = checkpointed(written.union(saved.select("position", "stem", "saved_path")))
    results = I.import_results(marked, rules_table(spark, tuple(sites)))
    key = F.concat_ws("/", F.col("position.export_id").cast("string"), F.col("position.position").cast("string"))
    files_of = written.filter("saved_path is not null").select("position", F.col("saved_path").alias("file_path"))
    stored = rows.select(place.alias("position"), "payload").join(files_of, "position").select(key.alias("archive_id"), "payload")
    counted = B.count_chapters(stored, explode_archives(stored))
    full = checkpointed(
        results.join(files_of, "position", "left").withColumn("archive_id", key).join(counted, "archive_id", "left").select(
            "position.export_id", "position.position", "id", "source_url", "title", "status", "parser", "detail",
            F.coalesce("chapters", F.lit(0)).cast("int").alias("chapter_count"), "file_path",
        )
    )
    entries = library.unionByName(I.library_rows(full, at).select(library.columns))
    return Import(full, entries, unreadable_exports(exports, rows))

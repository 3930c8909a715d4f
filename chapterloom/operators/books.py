"""Book assembly as tables: chapter documents, manifest, metadata, appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import escape_markup
from ..functions.urls import entry_id
from .ordering import with_ordinal

# ---- fixed values -------------------------------------------------------
CHAPTER_FILE = "text/chapter_%04d.xhtml"
CHAPTER_NUMBER = r"(?:^|.*/)chapter_(\d+)\.xhtml$"
NOT_A_CHAPTER = r"(?i)(information|cover|title|toc|nav|contents)"
# -------------------------------------------------------------------------


def with_placeholders(selection: DataFrame, contents: DataFrame, notice: str = "[chapterloom]") -> DataFrame:
    """Selected chapters with bodies; a failed one keeps its place with a note.

    ``contents`` has (novel_id, chapter_index, title, html, status, reason).
    Chapters that were never attempted have no row there; see ``completed_prefix``.
    """
    body = contents.select(
        "novel_id", "chapter_index", F.col("title").alias("_title"), "html", "status", "reason"
    )
    joined = selection.join(body, ["novel_id", "chapter_index"], "left")
    failed = F.coalesce(F.col("status") != "ok", F.lit(False))
    note = F.concat(
        F.lit(f"<p><em>{notice} No text was found for this chapter; it should be at <a href=\""),
        F.col("url"), F.lit('">'), F.col("url"), F.lit("</a></em></p>"),
    )
    warning = F.concat(
        F.lit("#"), F.col("chapter_index").cast("string"), F.lit(" "), F.col("title"), F.lit(": "), F.col("reason")
    )
    return joined.select(
        *[c for c in selection.columns if c != "title"],
        F.when(failed, F.col("title")).otherwise(F.coalesce("_title", "title")).alias("title"),
        F.when(failed, note).otherwise(F.col("html")).alias("html"),
        F.when(failed, warning).alias("warning"),
        F.col("status").isNotNull().alias("attempted"),
        failed.alias("failed"),
    )


def completed_prefix(chapters: DataFrame, key: str = "novel_id") -> DataFrame:
    """Chapters before the first one that was not attempted."""
    ends = chapters.groupBy(key).agg(
        F.min(F.when(~F.col("attempted"), F.col("chapter_index"))).alias("_stop")
    )
    return (
        chapters.join(ends, key)
        .filter(F.col("_stop").isNull() | (F.col("chapter_index") < F.col("_stop")))
        .drop("_stop")
    )


def stop_warnings(chapters: DataFrame, key: str = "novel_id") -> DataFrame:
    """Per key: delivered and selected counts, and a warning or an error after an early stop."""
    rows = chapters.select(key, "chapter_index", "attempted")
    ends = rows.groupBy(key).agg(F.min(F.when(~F.col("attempted"), F.col("chapter_index"))).alias("_stop"))
    before = F.col("_stop").isNull() | (F.col("chapter_index") < F.col("_stop"))
    counted = rows.join(ends, key).groupBy(key).agg(F.count_if(before).alias("delivered"), F.count("*").alias("selected"))
    k, n = F.col("delivered"), F.col("selected")
    return counted.select(
        key,
        "delivered",
        "selected",
        F.when((k > 0) & (k < n), F.format_string("%d of %d chapters, then stopped", k, n)).alias("warning"),
        F.when(k == 0, F.lit("stopped_empty")).alias("detail"),
    )


def with_position(chapters: DataFrame) -> DataFrame:
    """1-based place in the book, whatever the catalog numbers are."""
    return with_ordinal(chapters, ["novel_id"], ["chapter_index"], "position")


def book_manifest(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Reading order as rows: navigation, title page, then the chapters.

    ``books`` has (novel_id, title); ``chapters`` has (novel_id, position, title).
    """
    front = books.select(
        "novel_id",
        F.explode(
            F.array(
                F.struct(F.lit(1).cast("long").alias("spine"), F.lit("nav").alias("kind"),
                         F.lit("nav.xhtml").alias("file_name"), F.lit(None).cast("string").alias("title")),
                F.struct(F.lit(2).cast("long").alias("spine"), F.lit("title").alias("kind"),
                         F.lit("text/title.xhtml").alias("file_name"), F.col("title").alias("title")),
            )
        ).alias("f"),
    ).select("novel_id", "f.*")
    body = chapters.select(
        "novel_id",
        (F.col("position") + 2).alias("spine"),
        F.lit("chapter").alias("kind"),
        F.format_string(CHAPTER_FILE, "position").alias("file_name"),
        "title",
    )
    with_text = front.join(chapters.select("novel_id").distinct(), "novel_id", "left_semi")
    return with_text.unionByName(body).withColumn("in_toc", F.col("kind") == "chapter")


def book_record(metadata: DataFrame) -> DataFrame:
    """Dublin Core style pairs per book; absent values leave no pair."""
    def pair(key: str, value: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), value.alias("value"))

    fixed = F.array(
        pair("identifier", F.concat(F.lit("urn:uuid:"), entry_id(F.col("source_url")))),
        pair("title", F.col("title")),
        pair("language", F.coalesce(F.nullif("language", F.lit("")), F.lit("en"))),
        pair("creator", F.col("author")),
        pair("description", F.nullif("description", F.lit(""))),
        pair("publisher", F.nullif("publisher", F.lit(""))),
        pair("source", F.col("source_url")),
    )
    subjects = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: pair("subject", t))
    pairs = F.filter(F.concat(fixed, subjects), lambda p: p["value"].isNotNull())
    return metadata.select("novel_id", F.posexplode(pairs).alias("pos", "p")).select(
        "novel_id", "pos", "p.key", "p.value"
    )


def chapter_document(title: Column, html: Column) -> Column:
    """A chapter's page body: escaped heading, then the cleaned fragment."""
    return F.concat(F.lit('<h2 class="chapter-title">'), escape_markup(title), F.lit("</h2>\n"), html)


def title_page(title: Column, author: Column, description: Column, source_url: Column) -> Column:
    def part(before: str, value: Column, after: str) -> Column:
        full = F.concat(F.lit(before), escape_markup(value), F.lit(after))
        return F.when(F.coalesce(value, F.lit("")) != "", full)

    link = escape_markup(source_url)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("<h1>"), escape_markup(title), F.lit("</h1>")),
        part("<p><em>", author, "</em></p>"),
        part("<div>", description, "</div>"),
        F.concat(F.lit('<p class="source-note"><a href="'), link, F.lit('">'), link, F.lit("</a></p>")),
    )


def with_volume(chapters: DataFrame, per_volume: int | None = None) -> DataFrame:
    """Append ``position`` and ``volume``: one volume, or one for every ``per_volume`` chapters if asked for.

    The split follows the request alone, never the size of a book.
    """
    placed = with_position(chapters)
    if per_volume is None:
        return placed.withColumn("volume", F.lit(0))
    return placed.withColumn("volume", F.floor((F.col("position") - 1) / per_volume).cast("int"))


def in_one_volume(chapters: DataFrame) -> DataFrame:
    """Chapters in catalog order, for ``pack_books(..., numbered=False)``: one volume, and nothing is shuffled for numbers."""
    return chapters.withColumn("position", F.col("chapter_index").cast("long")).withColumn("volume", F.lit(0))


def append_names(manifest: DataFrame, fresh: DataFrame) -> DataFrame:
    """``fresh`` with the ``spine`` and ``file_name`` of each chapter behind the existing documents."""
    number = F.regexp_extract("file_name", CHAPTER_NUMBER, 1)
    ends = manifest.groupBy("novel_id").agg(
        F.coalesce(F.max(F.when(number != "", number.cast("long"))), F.lit(0)).alias("_number"),
        F.max("spine").alias("_spine"),
    )
    return fresh.join(ends, "novel_id").select(
        *fresh.columns,
        (F.col("_spine") + F.col("position")).alias("spine"),
        F.format_string(CHAPTER_FILE, F.col("_number") + F.col("position")).alias("file_name"),
    )


def append_chapters(manifest: DataFrame, fresh: DataFrame) -> DataFrame:
    """Existing documents followed by new ones; numbering continues from the highest.

    ``manifest`` has (novel_id, spine, file_name, title), ``fresh`` has
    (novel_id, position, title) with positions counted from 1 per novel. Only
    novels with new chapters are returned, since only they are rewritten.
    """
    columns = ["novel_id", "spine", "file_name", "title"]
    added = append_names(manifest, fresh).select(*columns, F.lit(True).alias("added"))
    old = manifest.join(fresh.select("novel_id").distinct(), "novel_id", "left_semi")
    return old.select(columns).withColumn("added", F.lit(False)).unionByName(added)


def repair_titles(documents: DataFrame, contents_list: DataFrame) -> DataFrame:
    """Fill missing document titles from the contents list, else from the file name."""
    listed = contents_list.select("novel_id", F.col("href").alias("file_name"), F.col("title").alias("_toc"))
    return documents.join(listed, ["novel_id", "file_name"], "left").withColumn(
        "title",
        F.coalesce(F.nullif("title", F.lit("")), F.nullif("_toc", F.lit("")), F.col("file_name")),
    ).drop("_toc")


def count_chapters(archives: DataFrame, documents: DataFrame) -> DataFrame:
    """Chapters per archive (archive_id); unreadable ones count zero."""
    real = documents.filter(~F.coalesce("file_name", F.lit("")).rlike(NOT_A_CHAPTER))
    sizes = real.groupBy("archive_id").agg(F.count("*").alias("chapters"))
    return archives.select("archive_id").join(sizes, "archive_id", "left").withColumn(
        "chapters", F.coalesce("chapters", F.lit(0))
    )


def book_summary(chapters: DataFrame, warnings: DataFrame, files: DataFrame) -> DataFrame:
    """Chapter count, warning count and saved path per book."""
    delivered = chapters.groupBy("novel_id").agg(F.count("*").alias("chapter_count"))
    noted = warnings.groupBy("novel_id").agg(F.count("*").alias("warning_count"))
    return (
        delivered.join(noted, "novel_id", "left")
        .join(files.select("novel_id", "saved_path"), "novel_id", "left")
        .withColumn("warning_count", F.coalesce("warning_count", F.lit(0)))
    )

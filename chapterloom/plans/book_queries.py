"""Book assembly over conversations: a conversation is a novel, a turn a chapter."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import escape_markup, slugify
from ..functions.urls import entry_id
from ..operators import books as B, naming
from ..session import checkpointed, shared_dir
from ..sources import archives as A, sink, splicing
from ..sources.pages import book_covers, stored_images, table
from ..sources.snapshots import ENTRY_TYPE, Snapshots
from . import lifecycle
from .fragments import CONVERSATIONS, conversation_chapters
from .registry import query


def _contents(spark, d):
    """Bodies: some failed, and in some novels the end was never attempted."""
    c = conversation_chapters(spark, d)
    failed = F.char_length("text") % 7 == 0
    tried = (F.col("novel_id") + F.col("chapter_index")) % 9 != 8
    return c.filter(tried).select(
        "novel_id", "chapter_index",
        F.when(~failed, F.concat(F.lit("Read "), F.col("title"))).alias("title"),
        F.when(~failed, F.concat(F.lit("<p>"), escape_markup(F.col("text")), F.lit("</p>"))).alias("html"),
        F.when(failed, F.lit("no_content")).otherwise(F.lit("ok")).alias("status"),
        F.when(failed, F.lit("No chapter content")).alias("reason"),
    )


def _chapters(spark, d):
    selection = conversation_chapters(spark, d).select("novel_id", "chapter_index", "title", "url")
    return B.with_placeholders(selection, _contents(spark, d))


_ESCAPED = """replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')"""
_CHAPTERS_SQL = f"""
    SELECT novel_id, chapter_index, url, attempted, attempted AND bad AS failed,
      CASE WHEN attempted AND NOT bad THEN 'Read ' || title ELSE title END AS title,
      CASE WHEN attempted AND bad THEN '<p><em>[chapterloom] No text was found for this chapter; it should be at <a href="' || url || '">' || url || '</a></em></p>'
           WHEN attempted THEN '<p>' || {_ESCAPED} || '</p>' END AS html,
      CASE WHEN attempted AND bad THEN '#' || chapter_index || ' ' || title || ': No chapter content' END AS warning
    FROM (SELECT *, length(text) % 7 = 0 AS bad, (novel_id + chapter_index) % 9 <> 8 AS attempted FROM ({CONVERSATIONS}))
"""
_PREFIX_SQL = f"""
    SELECT c.* FROM ({_CHAPTERS_SQL}) c LEFT JOIN (
        SELECT novel_id, min(chapter_index) AS stop FROM ({_CHAPTERS_SQL}) WHERE NOT attempted GROUP BY novel_id) s
    ON c.novel_id = s.novel_id WHERE stop IS NULL OR chapter_index < stop
"""


@query(f"SELECT novel_id, chapter_index, title, html, warning, failed FROM ({_CHAPTERS_SQL}) WHERE attempted")
def placeholder(spark, d):
    return _chapters(spark, d).filter("attempted").select("novel_id", "chapter_index", "title", "html", "warning", "failed")


@query(f"SELECT novel_id, chapter_index, title FROM ({_PREFIX_SQL})")
def completed_prefix(spark, d):
    return B.completed_prefix(_chapters(spark, d)).select("novel_id", "chapter_index", "title")


@query(f"""SELECT a.novel_id, coalesce(k, 0) AS delivered, n AS selected,
                  CASE WHEN k > 0 AND k < n THEN k || ' of ' || n || ' chapters, then stopped' END AS warning,
                  CASE WHEN k IS NULL THEN 'stopped_empty' END AS detail
           FROM (SELECT novel_id, count(*) AS n FROM ({_CHAPTERS_SQL}) GROUP BY novel_id) a
           LEFT JOIN (SELECT novel_id, count(*) AS k FROM ({_PREFIX_SQL}) GROUP BY novel_id) b ON a.novel_id = b.novel_id""")
def stop_warning(spark, d):
    return B.stop_warnings(_chapters(spark, d))


def _metadata(spark, d):
    c = conversation_chapters(spark, d)
    return c.groupBy("novel_id").agg(
        F.min_by("text", "chapter_index").alias("description"), F.count("*").alias("n")
    ).select(
        "novel_id",
        F.concat(F.lit("Talk <"), F.col("novel_id").cast("string"), F.lit('> "&"')).alias("title"),
        F.lit("Unknown").alias("author"),
        F.when(F.col("novel_id") % 3 > 0, F.col("description")).otherwise(F.lit("")).alias("description"),
        F.when(F.col("novel_id") % 2 == 0, F.lit("")).otherwise(F.lit("pl")).alias("language"),
        F.when(F.col("novel_id") % 4 == 0, F.lit("Talks")).alias("publisher"),
        F.concat(F.lit("https://talk.example.org/"), F.col("novel_id").cast("string")).alias("source_url"),
        F.array(F.lit("chat"), F.concat(F.lit("n"), F.col("n").cast("string"))).alias("tags"),
    )


_META_SQL = f"""
    SELECT novel_id, 'Talk <' || novel_id || '> "&"' AS title, 'Unknown' AS author,
      CASE WHEN novel_id % 3 > 0 THEN min_by(text, chapter_index) ELSE '' END AS description,
      CASE WHEN novel_id % 2 = 0 THEN '' ELSE 'pl' END AS language, CASE WHEN novel_id % 4 = 0 THEN 'Talks' END AS publisher,
      'https://talk.example.org/' || novel_id AS source_url, count(*) AS n
    FROM ({CONVERSATIONS}) GROUP BY novel_id
"""


def _positioned(spark, d):
    return B.with_position(B.completed_prefix(_chapters(spark, d)))


@query(f"""SELECT novel_id, row_number() OVER (PARTITION BY novel_id ORDER BY chapter_index) + 2 AS spine, 'chapter' AS kind,
                  'text/chapter_' || lpad(row_number() OVER (PARTITION BY novel_id ORDER BY chapter_index)::VARCHAR, 4, '0') || '.xhtml' AS file_name,
                  title, true AS in_toc FROM ({_PREFIX_SQL})
           UNION ALL SELECT DISTINCT novel_id, 1, 'nav', 'nav.xhtml', NULL, false FROM ({_PREFIX_SQL})
           UNION ALL SELECT DISTINCT novel_id, 2, 'title', 'text/title.xhtml', 'Talk <' || novel_id || '> "&"', false FROM ({_PREFIX_SQL})""")
def book_manifest(spark, d):
    return B.book_manifest(_metadata(spark, d).select("novel_id", "title"), _positioned(spark, d))


_UUID = """(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
    substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)
    FROM (SELECT sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(source_url)) AS h))"""


@query(f"""WITH m AS ({_META_SQL})
           SELECT novel_id, key, value FROM (
             SELECT novel_id, 'identifier' AS key, 'urn:uuid:' || {_UUID} AS value FROM m
             UNION ALL SELECT novel_id, 'title', title FROM m
             UNION ALL SELECT novel_id, 'language', coalesce(nullif(language, ''), 'en') FROM m
             UNION ALL SELECT novel_id, 'creator', author FROM m
             UNION ALL SELECT novel_id, 'description', nullif(description, '') FROM m
             UNION ALL SELECT novel_id, 'publisher', publisher FROM m
             UNION ALL SELECT novel_id, 'source', source_url FROM m
             UNION ALL SELECT novel_id, 'subject', 'chat' FROM m
             UNION ALL SELECT novel_id, 'subject', 'n' || n FROM m) WHERE value IS NOT NULL""")
def book_meta(spark, d):
    return B.book_record(_metadata(spark, d)).select("novel_id", "key", "value")


@query(f"""SELECT novel_id, chapter_index, '<h2 class="chapter-title">' || replace(title, '&', '&amp;') || '</h2>' || chr(10) || html AS document
           FROM ({_PREFIX_SQL})""")
def chapter_doc(spark, d):
    c = B.completed_prefix(_chapters(spark, d))
    return c.select("novel_id", "chapter_index", B.chapter_document(F.col("title"), F.col("html")).alias("document"))


@query(f"""SELECT novel_id, '<h1>' || replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</h1>' || chr(10) ||
                  '<p><em>Unknown</em></p>' || chr(10) ||
                  CASE WHEN text = '' THEN '' ELSE '<div>' || {_ESCAPED} || '</div>' || chr(10) END ||
                  '<p class="source-note"><a href="' || source_url || '">' || source_url || '</a></p>' AS page
           FROM (SELECT *, description AS text FROM ({_META_SQL}))""")
def title_page(spark, d):
    page = B.title_page(F.col("title"), F.col("author"), F.col("description"), F.col("source_url"))
    return _metadata(spark, d).select("novel_id", page.alias("page"))


def _archives(spark, d):
    meta = _metadata(spark, d)
    record = B.book_record(meta).groupBy("novel_id").agg(
        # A record has a handful of pairs and the novel's tags.
        F.transform(
            F.sort_array(F.collect_list(F.struct("pos", "key", "value"))),
            lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value")),
        ).alias("record")
    )
    page = B.title_page(F.col("title"), F.col("author"), F.col("description"), F.col("source_url"))
    heads = meta.withColumn("title_page", page).join(record, "novel_id")
    return A.pack_books(heads, B.in_one_volume(B.completed_prefix(_chapters(spark, d))), numbered=False)


@query(f"""SELECT novel_id, 0 AS volume, count(*) AS chapter_count, true AS is_zip, 'talk-' || novel_id || '.epub' AS file_name
           FROM ({_PREFIX_SQL}) GROUP BY novel_id""")
def book_archive(spark, d):
    named = A.archive_names(_archives(spark, d), _metadata(spark, d))
    zipped = F.hex(F.substring("payload", 1, 4)) == "504B0304"
    return named.select("novel_id", "volume", "chapter_count", zipped.alias("is_zip"), "file_name")


@query(f"""SELECT novel_id, row_number() OVER (PARTITION BY novel_id ORDER BY chapter_index) + 1 AS spine,
                  'text/chapter_' || lpad(row_number() OVER (PARTITION BY novel_id ORDER BY chapter_index)::VARCHAR, 4, '0') || '.xhtml' AS file_name,
                  title AS toc_title, true AS whole FROM ({_PREFIX_SQL})
           UNION ALL SELECT DISTINCT novel_id, 1, 'text/title.xhtml', NULL, false FROM ({_PREFIX_SQL})""")
def book_explode(spark, d):
    packed = _archives(spark, d).select(F.col("novel_id").alias("archive_id"), "payload")
    docs = A.explode_archives(packed)
    body = _positioned(spark, d).select(
        F.col("novel_id").alias("archive_id"), F.format_string(B.CHAPTER_FILE, "position").alias("file_name"), "html"
    )
    both = docs.join(body.withColumnRenamed("html", "_html"), ["archive_id", "file_name"], "left")
    whole = F.coalesce(F.contains("html", "_html"), F.lit(False))
    return both.select(F.col("archive_id").alias("novel_id"), "spine", "file_name", "toc_title", whole.alias("whole"))


@query(f"""SELECT c.novel_id AS archive_id, coalesce(n, 0) AS chapters FROM (SELECT DISTINCT novel_id FROM ({_PREFIX_SQL})) c
           LEFT JOIN (SELECT novel_id, count(*) AS n FROM ({_PREFIX_SQL}) WHERE novel_id % 10 <> 0 GROUP BY novel_id) n ON c.novel_id = n.novel_id""")
def count_chapters(spark, d):
    # Every tenth archive is cut short and cannot be read.
    packed = _archives(spark, d).select(
        F.col("novel_id").alias("archive_id"),
        F.when(F.col("novel_id") % 10 == 0, F.substring("payload", 1, 60)).otherwise(F.col("payload")).alias("payload"),
    )
    return B.count_chapters(packed, A.explode_archives(packed))


def _split(spark, d):
    """Manifest of each novel's first turns, with gaps in its numbers, and the rest as new."""
    c = conversation_chapters(spark, d)
    old = c.filter("chapter_index <= 3").select(
        "novel_id", "chapter_index",
        F.col("chapter_index").alias("spine"),
        F.format_string(B.CHAPTER_FILE, F.col("chapter_index") * 2).alias("file_name"), "title",
    )
    fresh = c.filter("chapter_index > 3").select("novel_id", (F.col("chapter_index") - 3).alias("position"), "title")
    return old, fresh


@query(f"""WITH c AS ({CONVERSATIONS}), t AS (SELECT novel_id FROM c WHERE chapter_index > 3 GROUP BY novel_id)
           SELECT c.novel_id, chapter_index AS spine, title, chapter_index > 3 AS added,
             'text/chapter_' || lpad((CASE WHEN chapter_index <= 3 THEN chapter_index * 2 ELSE chapter_index + 3 END)::VARCHAR, 4, '0') || '.xhtml' AS file_name
           FROM c JOIN t ON c.novel_id = t.novel_id""")
def append_chapters(spark, d):
    old, fresh = _split(spark, d)
    return B.append_chapters(old.drop("chapter_index"), fresh)


def _stored_and_fresh(spark, d):
    """Archives of each novel's first turns, with gaps in their numbers, and the further turns."""
    c = conversation_chapters(spark, d).withColumn("html", F.concat(F.lit("<p>"), escape_markup(F.col("text")), F.lit("</p>")))
    first = c.filter("chapter_index <= 3").select(
        "novel_id", (F.col("chapter_index") * 2).alias("position"), F.lit(0).alias("volume"), "title", "html"
    )
    page = B.title_page(F.col("title"), F.col("author"), F.col("description"), F.col("source_url"))
    heads = _metadata(spark, d).withColumn("title_page", page).withColumn(
        "record", F.array(F.struct(F.lit("language").alias("key"), F.lit("pl").alias("value")))
    )
    archives = A.pack_books(heads, first).select(F.col("novel_id").alias("archive_id"), "payload")
    fresh = c.filter("chapter_index > 3").select(
        F.col("novel_id").alias("archive_id"), (F.col("chapter_index") - 3).alias("position"), "title", "html"
    )
    return archives, fresh


@query(f"""WITH c AS ({CONVERSATIONS}), t AS (SELECT novel_id, count(*) - 3 AS added FROM c GROUP BY novel_id HAVING max(chapter_index) > 3)
           SELECT c.novel_id, chapter_index + 1 AS spine, title AS toc_title, added, true AS whole, true AS kept,
             'text/chapter_' || lpad((CASE WHEN chapter_index <= 3 THEN chapter_index * 2 ELSE chapter_index + 3 END)::VARCHAR, 4, '0') || '.xhtml' AS file_name
           FROM c JOIN t ON c.novel_id = t.novel_id
           UNION ALL SELECT novel_id, 1, NULL, added, false, true, 'text/title.xhtml' FROM t""")
def update_archives(spark, d):
    """Stored archives get their new chapters: read back, all documents are there and the old members' bytes are untouched."""
    archives, fresh = _stored_and_fresh(spark, d)
    archives = checkpointed(archives)
    made = checkpointed(splicing.append_to_archives(archives, fresh))
    old = splicing.list_members(archives.join(made.select("archive_id"), "archive_id", "left_semi"))
    new = splicing.list_members(made).withColumn("_there", F.lit(True))
    lost = (
        old.filter(~F.col("member").isin("EPUB/nav.xhtml", "EPUB/content.opf"))
        .join(new, ["archive_id", "member", "method", "size", "packed_sha256"], "left").groupBy("archive_id")
        .agg(F.count_if(F.col("_there").isNull()).alias("_lost"))
    )
    c = conversation_chapters(spark, d)
    number = F.when(F.col("chapter_index") <= 3, F.col("chapter_index") * 2).otherwise(F.col("chapter_index") + 3)
    body = c.select(F.col("novel_id").alias("archive_id"), F.format_string(B.CHAPTER_FILE, number).alias("file_name"), escape_markup(F.col("text")).alias("_body"))
    docs = A.explode_archives(made).join(made.select("archive_id", "added"), "archive_id").join(lost, "archive_id")
    return docs.join(body, ["archive_id", "file_name"], "left").select(
        F.col("archive_id").alias("novel_id"), "spine", "toc_title", F.col("added").cast("long").alias("added"),
        F.coalesce(F.contains("html", "_body"), F.lit(False)).alias("whole"), (F.col("_lost") == 0).alias("kept"), "file_name",
    )


@query(f"""SELECT novel_id, CASE WHEN novel_id % 9 > 0 THEN 'talk-' || novel_id || '.epub' END AS file_name, novel_id % 9 > 0 AS there, count(*) AS chapters
           FROM ({_PREFIX_SQL}) GROUP BY novel_id""")
def book_sink(spark, d):
    """Archives saved as files by one job, then found by listing the folder and read back; every ninth has a name that no file can have."""
    folder = f"{shared_dir(spark)}/books-{uuid.uuid4().hex}"
    packed = checkpointed(A.archive_names(_archives(spark, d), _metadata(spark, d)))
    wanted = packed.withColumn("file_name", F.when(F.col("novel_id") % 9 == 0, F.concat(F.lit("no/"), "file_name")).otherwise(F.col("file_name")))
    saved = sink.save_archives(wanted.select("novel_id", "chapter_count", "file_name", "payload"), folder)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest")
    )
    both = saved.withColumn("name", F.element_at(F.split("saved_path", "/"), -1)).join(found, "name", "full")
    told = packed.select("novel_id", F.sha2("payload", 256).alias("packed"))
    return both.join(told, "novel_id", "left").select(
        "novel_id", F.col("name").alias("file_name"), F.coalesce(F.col("digest") == F.col("packed"), F.lit(False)).alias("there"),
        F.col("chapter_count").alias("chapters"),
    )


@query(f"""SELECT novel_id, chapter_index, CASE WHEN chapter_index % 3 = 0 THEN title WHEN chapter_index % 3 = 1 THEN 'TOC ' || title
                  ELSE 'c' || chapter_index || '.xhtml' END AS title FROM ({CONVERSATIONS})""")
def title_repair(spark, d):
    c = conversation_chapters(spark, d)
    name = F.concat(F.lit("c"), F.col("chapter_index").cast("string"), F.lit(".xhtml"))
    docs = c.select(
        "novel_id", "chapter_index", name.alias("file_name"),
        F.when(F.col("chapter_index") % 3 == 0, F.col("title")).otherwise(F.lit("")).alias("title"),
    )
    toc = c.filter("chapter_index % 3 <> 2").select("novel_id", name.alias("href"), F.concat(F.lit("TOC "), "title").alias("title"))
    return B.repair_titles(docs, toc).select("novel_id", "chapter_index", "title")


@query(f"""SELECT novel_id, count(*) AS chapter_count, count(warning) AS warning_count,
                  CASE WHEN novel_id % 2 = 0 THEN '/books/' || novel_id || '.epub' END AS saved_path FROM ({_PREFIX_SQL}) GROUP BY novel_id""")
def book_summary(spark, d):
    c = B.completed_prefix(_chapters(spark, d))
    files = c.filter("novel_id % 2 = 0").select("novel_id").distinct().withColumn(
        "saved_path", F.concat(F.lit("/books/"), F.col("novel_id").cast("string"), F.lit(".epub"))
    )
    return B.book_summary(c, c.filter("warning is not null"), files)


_KIND = "CASE novel_id % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'gif' WHEN 3 THEN 'webp' END"
_MAGIC = "CASE novel_id % 5 WHEN 0 THEN '89504E470D0A1A0A' WHEN 1 THEN 'FFD8FFE0' WHEN 2 THEN '474946383961' WHEN 3 THEN '524946460000000057454250' ELSE '25504446' END"


@query(f"""SELECT p.novel_id, 'EPUB/cover.' || {_KIND.replace('novel_id', 'p.novel_id')} AS member, sha256(unhex({_MAGIC.replace('novel_id', 'p.novel_id')}) || encode(m.description)) AS digest
           FROM (SELECT DISTINCT novel_id FROM ({_PREFIX_SQL})) p JOIN (SELECT novel_id, min_by(text, chapter_index) AS description FROM ({CONVERSATIONS}) GROUP BY novel_id) m
             ON p.novel_id = m.novel_id WHERE p.novel_id % 5 < 4""")
def book_cover(spark, d):
    """Covers stored as files, found by reading them, told by their first bytes and read back out of the archives; a fifth are no images."""
    meta = _metadata(spark, d)
    text = conversation_chapters(spark, d).groupBy("novel_id").agg(F.min_by("text", "chapter_index").alias("text"))
    content = F.expr(f"concat(unhex({_MAGIC}), encode(text, 'UTF-8'))")
    folder = f"{shared_dir(spark)}/covers-{uuid.uuid4().hex}"
    sink.save_archives(text.select(F.concat(F.lit("cover-"), F.col("novel_id").cast("string")).alias("file_name"), content.alias("payload")), folder)
    images = stored_images(spark, folder).withColumn("url", F.concat(F.lit("https://talk.example.org/"), "file")).filter("file like 'cover-%'")
    heads = meta.select(
        "novel_id", "title", "language", F.lit("<h1>x</h1>").alias("title_page"),
        F.array(F.struct(F.lit("title").alias("key"), F.col("title").alias("value"))).alias("record"),
        F.concat(F.lit("https://talk.example.org/cover-"), F.col("novel_id").cast("string")).alias("cover_url"),
    )
    packed = A.pack_books(heads, B.with_volume(B.completed_prefix(_chapters(spark, d))), book_covers(heads, images))
    members = splicing.list_members(packed.select(F.col("novel_id").alias("archive_id"), "payload"))
    return members.filter(F.col("member").startswith("EPUB/cover.") & (F.col("method") == 0)).select(
        F.col("archive_id").alias("novel_id"), "member", F.col("packed_sha256").alias("digest")
    )


@query("""SELECT s_suppkey % 40 AS number, 'book-' || (s_suppkey % 40) || '.epub' AS file_name, bool_and(s_nationkey < 12) AS removed
          FROM supplier GROUP BY s_suppkey % 40""")
def library_vacuum(spark, d):
    """Suppliers share forty files; those of some nations are deleted, and a file goes when its last supplier does."""
    folder = f"{shared_dir(spark)}/vacuum-{uuid.uuid4().hex}"
    number = F.col("s_suppkey") % 40
    entries = checkpointed(table(spark, d, "supplier").select(
        F.col("s_suppkey").cast("string").alias("id"), "s_nationkey", number.alias("number"),
        F.concat(F.lit(f"{folder}/book-"), number.cast("string"), F.lit(".epub")).alias("file_path"),
    ))
    files = entries.select("number", F.element_at(F.split("file_path", "/"), -1).alias("file_name")).distinct()
    saved = checkpointed(sink.save_archives(files.withColumn("payload", F.encode("file_name", "UTF-8")), folder))
    library = entries.select("id", "file_path")
    store = Snapshots(spark, f"{folder}/library")
    store.write(library)
    removed = lifecycle.delete_from_library(store, entries.filter("s_nationkey < 12").select("id"), folder, library.schema)
    left = sink.listed_files(spark, folder).select("file_path", F.lit(True).alias("there"))
    told = saved.withColumnRenamed("saved_path", "file_path").join(removed, "file_path", "left").join(left, "file_path", "left")
    return told.select("number", "file_name", (F.coalesce("removed", F.lit(False)) & F.col("there").isNull()).alias("removed"))


NOVELS, EXPORT = 150, 20


@query(f"""WITH a AS (SELECT novel_id, count(*) AS n FROM ({_PREFIX_SQL}) GROUP BY novel_id),
                r AS (SELECT novel_id, novel_id // {EXPORT} AS export_id, novel_id % {NOVELS} AS novel, n,
                             row_number() OVER (PARTITION BY novel_id // {EXPORT} ORDER BY novel_id) - 1 AS position FROM a),
                s AS (SELECT *, novel % 11 > 0 AND row_number() OVER (PARTITION BY novel ORDER BY novel_id) = 1 AS fresh FROM r),
                f AS (SELECT *, 'novel-' || chr(97 + (novel_id % 5)::INT) AS slug,
                             row_number() OVER (PARTITION BY novel_id % 5, fresh ORDER BY novel_id) AS k FROM s)
           SELECT export_id, position, CASE WHEN fresh THEN 'imported' ELSE 'skipped' END AS status, CASE WHEN fresh THEN n ELSE 0 END AS chapter_count,
                  CASE WHEN fresh THEN slug || CASE WHEN k + (slug = 'novel-c')::INT > 1 THEN '-' || (k + (slug = 'novel-c')::INT) ELSE '' END || '.epub' END AS file_name,
                  fresh AS entered FROM f
           UNION ALL SELECT -1, 0, 'import_error', 0, NULL, false""")
def import_library(spark, d):
    """Exports of archives into a library that knows every eleventh novel and has a file of one of the names."""
    archives = checkpointed(_archives(spark, d).select("novel_id", "payload"))
    novel = F.col("novel_id") % NOVELS
    address = F.concat(F.lit("https://freewebnovel.com/novel/n-"), novel.cast("string"))
    title = F.concat(F.lit("Novel "), F.char(F.lit(97) + (F.col("novel_id") % 5)))
    rows = archives.select(
        "novel_id", F.floor(F.col("novel_id") / EXPORT).alias("export_id"),
        F.struct(address.alias("LibStoryURL"), title.alias("LibFilename"), F.base64("payload").alias("LibEpub")).alias("novel"),
    )
    # An export holds twenty novels at most.
    listed = rows.groupBy("export_id").agg(F.sort_array(F.collect_list(F.struct("novel_id", "novel"))).alias("rows"))
    library_json = F.to_json(F.struct(F.transform("rows", lambda r: r["novel"]).alias("Library")))
    readable = listed.select("export_id", F.encode(library_json, "UTF-8").alias("content"))
    broken = spark.range(1).select(F.lit(-1).cast("long"), F.encode(F.lit('{"Library": ["no novel"]}'), "UTF-8"))
    exports = checkpointed(readable.union(broken))  # exports are files in earnest
    known = archives.select(novel.alias("n")).distinct().filter("n % 11 = 0").select(
        entry_id(F.concat(F.lit("https://freewebnovel.com/novel/n-"), F.col("n").cast("string"))).alias("id"), F.lit("/books/novel-c.epub").alias("file_path")
    )
    library = known.select(*[F.col(f.name) if f.name in known.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in ENTRY_TYPE])
    done = lifecycle.import_library(exports, library, f"{shared_dir(spark)}/imported-{uuid.uuid4().hex}", F.lit("2025-01-01T00:00:00Z"))
    entered = done.library.filter("created_at is not null").select("id", "file_path", F.lit(True).alias("entered"))
    return done.results.join(entered, ["id", "file_path"], "left").select(
        "export_id", F.col("position").cast("long").alias("position"), "status", F.col("chapter_count").cast("long").alias("chapter_count"),
        F.element_at(F.split("file_path", "/"), -1).alias("file_name"), F.coalesce("entered", F.lit(False)).alias("entered"),
    ).union(done.errors.select("export_id", F.lit(0), "detail", F.lit(0), F.lit(None).cast("string"), F.lit(False)))


# Suffixes in use by segment: suppliers own files named after segments, as "-k".
@query("""WITH a AS (SELECT c_custkey, lower(c_mktsegment) AS slug, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn FROM customer),
               used AS (SELECT DISTINCT slug, s_suppkey + 1 AS k FROM supplier, (SELECT DISTINCT slug FROM a) WHERE s_suppkey % 5 = length(slug) % 5),
               free AS (SELECT slug, k, row_number() OVER (PARTITION BY slug ORDER BY k) AS rn FROM (
                        SELECT slug, unnest(range(1, 1000)) AS k FROM (SELECT DISTINCT slug FROM a)) g
                        WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.slug = g.slug AND u.k = g.k))
          SELECT c_custkey, a.slug, CASE WHEN k = 1 THEN a.slug WHEN k IS NOT NULL THEN a.slug || '-' || k END AS stem
          FROM a LEFT JOIN free f ON a.slug = f.slug AND a.rn = f.rn""")
def free_names(spark, d):
    arrivals = table(spark, d, "customer").select(
        slugify(F.col("c_mktsegment")).alias("slug"), F.col("c_custkey").alias("arrival")
    )
    k = F.col("s_suppkey") + 1
    segments = arrivals.select("slug").distinct()
    suppliers = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 5).alias("_r"))
    owned = segments.withColumn("_r", (F.char_length("slug") % 5).cast("long")).join(suppliers, "_r")
    existing = owned.select(F.when(k == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), k.cast("string"))).alias("stem"))
    return naming.free_names(arrivals, existing).select(F.col("arrival").alias("c_custkey"), "slug", "stem")

"""Library state, updates and imports.

orders are the source lists: a customer is a novel. The stored library holds
the orders before a cut-off date, so later ones are new chapters.
"""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..functions import nodes as N
from ..functions.urls import entry_id
from ..operators import imports as I, library as L
from ..operators.ordering import with_ordinal
from ..session import checkpointed, shared_dir
from ..sources import exports as X, snapshots as S
from ..sources.pages import table
from .fragments import LINKS_SQL, NAV_LINKS, ORDER_CATALOG, order_catalog, page_nodes
from .registry import query
from .site_rules import rules_table
from .url_queries import CORPUS

CUTOFF = 955411200_000000
_CAT = f"SELECT CAST(novel_id AS VARCHAR) AS id, * FROM ({ORDER_CATALOG})"


def _catalog(spark, d):
    c = order_catalog(spark, d)
    return c.withColumn("id", F.col("novel_id").cast("string"))


def _library(spark, d):
    """Stored entries: counts and last URLs as of the cut-off; some have no file, some were reordered."""
    old = _catalog(spark, d).filter(F.col("ordered_us") < CUTOFF).groupBy("id").agg(
        F.max("chapter_index").alias("chapter_count"),
        F.max_by("url", "chapter_index").alias("_last"),
    )
    key = F.col("id").cast("long")
    url = F.when(key % 11 == 0, F.concat("_last", F.lit("-moved"))).when(key % 13 != 0, F.col("_last"))
    return old.select(
        "id",
        F.concat(F.lit("Novel "), "id").alias("title"),
        (key % 7 != 0).alias("has_file"),
        F.when(key % 7 != 0, F.concat(F.lit("/books/"), "id", F.lit(".epub"))).alias("file_path"),
        "chapter_count",
        url.alias("last_chapter_url"),
    )


_LIB = f"""
    SELECT id, 'Novel ' || id AS title, k % 7 <> 0 AS has_file, CASE WHEN k % 7 <> 0 THEN '/books/' || id || '.epub' END AS file_path,
           chapter_count, CASE WHEN k % 11 = 0 THEN last || '-moved' WHEN k % 13 <> 0 THEN last END AS last_chapter_url
    FROM (SELECT id, CAST(id AS BIGINT) AS k, max(chapter_index) AS chapter_count, max_by(url, chapter_index) AS last
          FROM ({_CAT}) WHERE ordered_us < {CUTOFF} GROUP BY id)
"""


@query(f"""SELECT coalesce(o.id, n.id) AS id, coalesce(o.created, n.created) AS created_at, coalesce(n.url, o.url) AS last_chapter_url,
                  coalesce(n.n, o.n) AS chapter_count
           FROM (SELECT id, min(ordered_us) AS created, max_by(url, chapter_index) AS url, max(chapter_index) AS n FROM ({_CAT}) WHERE ordered_us < {CUTOFF} GROUP BY id) o
           FULL JOIN (SELECT id, min_by(ordered_us, chapter_index) AS created, max_by(url, chapter_index) AS url, max(chapter_index) AS n
                      FROM ({_CAT}) WHERE ordered_us >= {CUTOFF} GROUP BY id) n ON o.id = n.id""")
def library_upsert(spark, d):
    c = _catalog(spark, d)
    stored = c.filter(F.col("ordered_us") < CUTOFF).groupBy("id").agg(
        F.min("ordered_us").alias("created_at"),
        F.max_by("url", "chapter_index").alias("last_chapter_url"),
        F.max("chapter_index").alias("chapter_count"),
    )
    changes = c.filter(F.col("ordered_us") >= CUTOFF).select(
        "id", F.col("ordered_us").alias("created_at"), F.col("url").alias("last_chapter_url"),
        F.col("chapter_index").alias("chapter_count"), F.col("chapter_index").alias("seq"),
    )
    return L.upsert(stored, changes)


@query(f"""SELECT w.id, title, chapter_count, CASE WHEN title IS NULL THEN 'unknown_entry' END AS detail
           FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events UNION SELECT DISTINCT 'x' || user_id FROM events) w
           LEFT JOIN ({_LIB}) l ON w.id = l.id""")
def library_get(spark, d):
    users = table(spark, d, "events").select(F.col("user_id").cast("string").alias("id"))
    ids = users.unionByName(users.select(F.concat(F.lit("x"), "id").alias("id")))
    return L.get_entries(_library(spark, d), ids).select("id", "title", "chapter_count", "detail")


@query(f"""SELECT id, file_path, id IN (SELECT CAST(user_id AS VARCHAR) FROM events) AS removed FROM ({_LIB})""")
def library_delete(spark, d):
    ids = table(spark, d, "events").select(F.col("user_id").cast("string").alias("id"))
    kept, removed = L.delete_entries(_library(spark, d), ids)
    return kept.withColumn("removed", F.lit(False)).unionByName(removed.withColumn("removed", F.lit(True))).select("id", "file_path", "removed")


_UUID = """substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
    substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"""
_NS = "unhex('6ba7b8119dad11d180b400c04fd430c8')"


@query(f"""SELECT {_UUID} AS id, CASE WHEN c_nationkey % 2 = 0 THEN 'example' ELSE 'unknown' END AS parser, c_name AS title,
                  CASE WHEN c_acctbal > 0 THEN '/books/' || c_custkey || '.epub' END AS file_path, coalesce(n, 0) AS chapter_count, last_chapter_url
           FROM (SELECT *, sha1({_NS} || encode('https://shop.example.org/n/' || c_custkey)) AS h FROM customer)
           LEFT JOIN (SELECT novel_id, max(chapter_index) AS n, max_by(url, chapter_index) AS last_chapter_url
                      FROM ({ORDER_CATALOG}) WHERE chapter_index % 2 = 1 GROUP BY novel_id) ON novel_id = c_custkey""")
def library_record(spark, d):
    key = F.col("c_custkey").cast("string")
    meta = table(spark, d, "customer").select(
        F.col("c_custkey").alias("novel_id"),
        F.concat(F.lit("https://shop.example.org/n/"), key).alias("source_url"),
        F.when(F.col("c_nationkey") % 2 == 0, F.lit("example")).alias("site"),
        F.col("c_name").alias("title"), F.lit("Unknown").alias("author"), F.lit("en").alias("language"),
        F.lit(None).cast("string").alias("cover_url"), F.timestamp_micros(F.lit(CUTOFF)).alias("at"), "c_acctbal",
    )
    files = meta.filter("c_acctbal > 0").select(
        "novel_id", F.concat(F.lit("/books/"), F.col("novel_id").cast("string"), F.lit(".epub")).alias("file_path")
    )
    delivered = order_catalog(spark, d).filter("chapter_index % 2 = 1")
    rows = L.record_conversions(meta.drop("c_acctbal"), delivered, files)
    return rows.select("id", "parser", "title", "file_path", "chapter_count", "last_chapter_url")


@query(f"""SELECT id, max(ordered_us) AS updated_at FROM ({_CAT}) GROUP BY id""")
def library_recent(spark, d):
    rows = _catalog(spark, d).groupBy("id").agg(F.max("ordered_us").alias("updated_at"))
    return L.most_recent_first(rows)


@query(f"""SELECT c.id, c.chapter_index, c.url FROM ({_CAT}) c JOIN ({_LIB}) l ON c.id = l.id WHERE c.chapter_index > l.chapter_count""")
def incremental_new(spark, d):
    return L.new_chapters(_library(spark, d), _catalog(spark, d)).select("id", "chapter_index", "url")


@query(f"""SELECT l.id, last_chapter_url AS expected, c.url AS found FROM ({_LIB}) l JOIN ({_CAT}) c ON c.id = l.id AND c.chapter_index = l.chapter_count
           WHERE last_chapter_url IS NOT NULL AND last_chapter_url <> c.url""")
def list_shifted(spark, d):
    return L.shifted_lists(_library(spark, d), _catalog(spark, d))


@query(f"""SELECT l.id, CASE WHEN NOT has_file THEN 'no_file' WHEN n IS NULL THEN 'up_to_date' ELSE 'updated' END AS status,
                  CASE WHEN has_file THEN coalesce(n, 0) ELSE 0 END AS added_chapters
           FROM ({_LIB}) l LEFT JOIN (SELECT c.id, count(*) AS n FROM ({_CAT}) c JOIN ({_LIB}) x ON c.id = x.id
                  WHERE c.chapter_index > x.chapter_count GROUP BY c.id) a ON l.id = a.id""")
def update_status(spark, d):
    return L.update_all(_library(spark, d), _catalog(spark, d)).select("id", "status", "added_chapters")


def _outcomes(spark, d):
    """Attempts: every twelfth order is where the work stopped, some failed."""
    c = _catalog(spark, d)
    return c.filter("o_orderkey % 12 <> 0").select(
        "id", "chapter_index",
        (F.col("o_orderpriority") == "1-URGENT").alias("failed"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("lost "), F.col("o_orderkey").cast("string"))).alias("reason"),
    )


def _errors(spark, d):
    return _library(spark, d).filter(F.col("id").cast("long") % 17 == 0).select(
        "id", F.concat(F.lit("parser_error: no list for "), "id").alias("detail")
    )


def _results(spark, d):
    return L.update_all(_library(spark, d), _catalog(spark, d), _outcomes(spark, d), _errors(spark, d))


_UPDATE = f"""
    WITH l AS ({_LIB}), c AS ({_CAT}),
    fresh AS (SELECT c.*, l.chapter_count, o_orderkey % 12 <> 0 AS tried FROM c JOIN l ON c.id = l.id WHERE c.chapter_index > l.chapter_count AND has_file),
    ends AS (SELECT id, count(*) AS n_new, min(CASE WHEN NOT tried THEN chapter_index END) AS stop FROM fresh GROUP BY id),
    done AS (SELECT f.* FROM fresh f JOIN ends e ON f.id = e.id WHERE stop IS NULL OR chapter_index < stop),
    sums AS (SELECT id, count(*) AS n_added, max(chapter_index) AS last, max_by(url, chapter_index) AS last_url,
                    string_agg(CASE WHEN o_orderpriority = '1-URGENT' THEN '#' || chapter_index || ' ' || title || ': lost ' || o_orderkey END, '; ' ORDER BY chapter_index) AS w
             FROM done GROUP BY id),
    shift AS (SELECT l.id FROM l JOIN c ON c.id = l.id AND c.chapter_index = l.chapter_count WHERE last_chapter_url <> c.url),
    res AS (SELECT l.*, CASE WHEN NOT has_file THEN 'no_file' WHEN CAST(l.id AS BIGINT) % 17 = 0 THEN 'error' WHEN n_new IS NULL THEN 'up_to_date'
                   WHEN coalesce(n_added, 0) < n_new THEN 'stopped' ELSE 'updated' END AS status, coalesce(n_added, 0) AS n_added, last, last_url, w,
                   s.id IS NOT NULL AS shifted
            FROM l LEFT JOIN ends ON l.id = ends.id LEFT JOIN sums ON l.id = sums.id LEFT JOIN shift s ON l.id = s.id)
    SELECT id, title, status, CASE WHEN changed THEN n_added ELSE 0 END AS added_chapters,
           CASE WHEN changed THEN last ELSE chapter_count END AS chapter_count,
           CASE WHEN changed THEN last_url ELSE last_chapter_url END AS last_chapter_url,
           CASE status WHEN 'no_file' THEN 'no_epub_on_disk' WHEN 'error' THEN 'parser_error: no list for ' || id
                ELSE CASE WHEN changed THEN nullif(concat_ws('; ', CASE WHEN shifted THEN 'chapter_list_shifted' END, w), '') END END AS detail
    FROM (SELECT *, status IN ('stopped', 'updated') AND n_added > 0 AS changed FROM res)
"""


@query(_UPDATE)
def update_all(spark, d):
    return _results(spark, d)


@query(f"""
    WITH l AS ({_LIB}), c AS ({_CAT}),
    fresh AS (SELECT c.*, o_orderkey % 12 <> 0 AS tried FROM c JOIN l ON c.id = l.id WHERE c.chapter_index > l.chapter_count AND has_file),
    ends AS (SELECT id, min(CASE WHEN NOT tried THEN chapter_index END) AS stop FROM fresh GROUP BY id)
    SELECT f.id, chapter_index, '#' || chapter_index || ' ' || title || ': lost ' || o_orderkey AS warning
    FROM fresh f JOIN ends e ON f.id = e.id WHERE (stop IS NULL OR chapter_index < stop) AND o_orderpriority = '1-URGENT'""")
def update_warnings(spark, d):
    return L.update_warnings(_library(spark, d), _catalog(spark, d), _outcomes(spark, d))


@query(f"""SELECT id, chapter_count, last_chapter_url, CASE WHEN added_chapters > 0 THEN {CUTOFF} ELSE 0 END AS updated_at FROM ({_UPDATE})""")
def update_apply(spark, d):
    library = _library(spark, d).withColumn("updated_at", F.lit(0).cast("long"))
    done = L.apply_updates(library, _results(spark, d), F.lit(CUTOFF).cast("long"))
    return done.select("id", "chapter_count", "last_chapter_url", "updated_at")


@query(f"""SELECT count(*) AS checked, count(*) FILTER (status = 'updated') AS updated, count(*) FILTER (status = 'error') AS failed FROM ({_UPDATE})""")
def update_counts(spark, d):
    return L.update_counts(_results(spark, d))


@query(f"""SELECT run_id, id, position FROM (
             SELECT CAST(id AS BIGINT) % 50 AS run_id, id, row_number() OVER (PARTITION BY CAST(id AS BIGINT) % 50 ORDER BY CAST(id AS BIGINT)) AS position FROM ({_LIB}))
           WHERE run_id % 3 <> 0 OR position < run_id % 10 + 1""")
def series_prefix(spark, d):
    from ..operators.ordering import with_ordinal

    entries = _library(spark, d).select(
        (F.col("id").cast("long") % 50).alias("run_id"), "id", F.col("id").cast("long").alias("_n")
    )
    results = with_ordinal(entries, ["run_id"], ["_n"], "position")
    stops = results.filter("run_id % 3 = 0").select("run_id", (F.col("run_id") % 10 + 1).alias("stop_at")).distinct()
    return L.series_prefix(results, stops).select("run_id", "id", "position")


@query(f"""SELECT o_orderkey, CASE WHEN l.id IS NULL THEN 'unknown_entry' WHEN file_path IS NULL THEN 'no_epub_on_disk'
                  WHEN CAST(l.id AS BIGINT) % 5 = 0 THEN 'epub_file_missing' ELSE 'ok' END AS download
           FROM orders LEFT JOIN ({_LIB}) l ON l.id = CASE WHEN o_orderstatus = 'P' THEN 'gone' ELSE CAST(o_custkey AS VARCHAR) END""")
def download_status(spark, d):
    library = _library(spark, d)
    inventory = library.filter(F.col("file_path").isNotNull() & (F.col("id").cast("long") % 5 != 0)).select("file_path")
    asked = F.when(F.col("o_orderstatus") == "P", F.lit("gone")).otherwise(F.col("o_custkey").cast("string"))
    requests = table(spark, d, "orders").select("o_orderkey", asked.alias("id"))
    return L.download_status(requests, library, inventory).select("o_orderkey", "download")


def _links(spark, d):
    """Per page, its nav links as (href, text) arrays."""
    nodes = F.col("nodes")
    return page_nodes(spark, d).select(
        "page_id",
        F.transform(
            N.matches(nodes, NAV_LINKS),
            lambda a: F.struct(a["attrs"]["href"].alias("href"), N.text_of(N.inside(nodes, a)).alias("text")),
        ).alias("links"),
    )


@query(f"""SELECT page_id, pos - 1 AS position, 'id' || pos AS id, text AS title, 'Unknown' AS author, CASE WHEN pos % 2 = 0 THEN pos ELSE 0 END AS chapter_count
           FROM ({LINKS_SQL}) WHERE page_id % 6 <> 0 AND pos <> 3""")
def library_load(spark, d):
    entry = lambda a, i: F.struct(
        F.when(i != 2, F.concat(F.lit("id"), (i + 1).cast("string"))).alias("id"),
        a["href"].alias("source_url"), F.lit("x").alias("parser"), a["text"].alias("title"),
        F.when(i % 2 == 1, i + 1).alias("chapter_count"),
        F.lit("2025-01-01T00:00:00+00:00").alias("created_at"), F.lit("2025-01-01T00:00:00+00:00").alias("updated_at"),
    )
    document = F.to_json(F.struct(F.lit(1).alias("version"), F.transform("links", entry).alias("entries")))
    broken = F.when(F.col("page_id") % 6 == 0, F.substring(document, 1, 30)).otherwise(document)
    docs = _links(spark, d).select("page_id", broken.alias("content"))
    rows = S.library_entries(docs, ["page_id"], F.col("content"))
    return rows.select("page_id", "position", "id", "title", "author", "chapter_count")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 OR c_nationkey = 0 THEN false ELSE c_acctbal > 0 END AS enabled,
                 CASE WHEN c_custkey % 7 = 0 OR c_nationkey = 0 THEN 24 ELSE c_nationkey END AS interval_hours FROM customer""")
def settings_load(spark, d):
    text = F.to_json(
        F.struct(
            F.struct(
                (F.col("c_acctbal") > 0).alias("auto_update_enabled"),
                F.col("c_nationkey").alias("auto_update_interval_hours"),
            ).alias("settings")
        )
    )
    broken = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("{"), text)).otherwise(text)
    docs = table(spark, d, "customer").select("c_custkey", broken.alias("content"))
    return S.settings_rows(docs, ["c_custkey"], F.col("content")).select("c_custkey", "enabled", "interval_hours")


@query(f"""SELECT page_id, pos AS seq, text AS trigger, CASE WHEN pos % 2 = 0 THEN 'skipped' ELSE 'ok' END AS status, pos AS checked
           FROM ({LINKS_SQL}) WHERE page_id % 6 <> 0 AND pos <> 3""")
def runs_load(spark, d):
    run = lambda a, i: F.struct(
        F.lit("2025-01-01T00:00:00+00:00").alias("started_at"),
        F.when(i != 2, F.lit("2025-01-01T00:00:00+00:00")).alias("finished_at"),
        a["text"].alias("trigger"), F.when(i % 2 == 1, F.lit("skipped")).alias("status"), (i + 1).alias("checked"),
    )
    document = F.to_json(F.struct(F.transform("links", run).alias("runs")))
    broken = F.when(F.col("page_id") % 6 == 0, F.substring(document, 1, 20)).otherwise(document)
    docs = _links(spark, d).select("page_id", broken.alias("content"))
    return S.run_rows(docs, ["page_id"], F.col("content")).select("page_id", "seq", "trigger", "status", "checked")


@query(f"SELECT id, title, chapter_count FROM ({_LIB})")
def library_save(spark, d):
    library = _library(spark, d).select("id", "title", "chapter_count")
    store = S.Snapshots(spark, f"{shared_dir(spark)}/library-{uuid.uuid4().hex}")
    store.write(library)
    return store.read(library.schema)


@query("""SELECT c_nationkey AS library_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS position, 'c-' || c_custkey AS id,
                 c_name AS title, CASE WHEN c_custkey % 3 > 0 THEN 'pl' ELSE 'en' END AS language, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS file_path,
                 c_custkey % 50 AS chapter_count FROM customer""")
def library_documents(spark, d):
    """Libraries written as versioned JSON files, an entry in three without a language, and read back from the folder."""
    customers = table(spark, d, "customer")
    key = F.col("c_custkey")
    row = {
        "id": F.concat(F.lit("c-"), key.cast("string")), "source_url": F.lit("https://a.example.org/x?\"y\""), "parser": F.lit("p"), "title": F.col("c_name"),
        "author": F.lit("A"), "language": F.when(key % 3 > 0, F.lit("pl")), "cover_url": F.lit(None).cast("string"),
        "file_path": F.when(key % 2 == 0, F.col("c_mktsegment")), "chapter_count": (key % 50).cast("int"), "last_chapter_url": F.lit(None).cast("string"),
        "created_at": F.lit("2025-01-01T00:00:00Z"), "updated_at": F.lit("2025-01-01T00:00:00Z"),
    }
    listed = with_ordinal(customers, ["c_nationkey"], ["c_custkey"], "_n").select(
        F.col("c_nationkey").alias("library_id"), (F.col("_n") - 1).alias("position"), *[c.alias(n) for n, c in row.items()]
    )
    folder = f"{shared_dir(spark)}/documents-{uuid.uuid4().hex}"
    documents = S.library_documents(listed, ["library_id"])
    # The text writer ends each file with a line feed, which JSON allows.
    documents.select("library_id", "part", F.col("content").alias("value")).write.partitionBy("library_id", "part").text(folder)
    stored = S.read_documents(spark, f"{folder}/library_id=*/part=*/*.txt")
    number = lambda name: F.regexp_extract("path", rf"/{name}=(\d+)/", 1).cast("long")
    keyed = stored.select(number("library_id").alias("library_id"), number("part").alias("part"), "content")
    back = S.library_entries(keyed, ["library_id", "part"], F.col("content"))
    return back.select(
        "library_id", (F.col("part") * S.DOCUMENT_ENTRIES + F.col("position")).alias("position"), "id", "title", "language", "file_path",
        F.col("chapter_count").cast("long").alias("chapter_count"),
    )


def _raw_rows(spark, d):
    """Export rows from nav links: one export per page, a novel per link.

    The third has no payload, the fourth a broken one, the fifth no file name.
    """
    rows = _links(spark, d).select("page_id", F.posexplode("links").alias("position", "a"))
    magic = F.concat(F.unhex(F.lit("504B0304")), F.encode(F.col("a.text"), "UTF-8"))
    uri = F.concat(F.lit("DATA:application/octet-stream;base64,"), F.base64(magic))
    p = F.col("position")
    return rows.select(
        F.col("page_id").alias("export_id"), "position",
        F.concat(F.lit("https://m.therou.example.com"), F.col("a.href"), F.lit("/")).alias("url"),
        F.when(p != 4, F.concat(F.lit(" "), "a.text")).alias("file_name"),
        F.when(p == 2, F.lit("")).when(p == 3, F.lit("data:;base64,AAAA")).when(p == 1, F.base64(magic)).otherwise(uri).alias("payload_text"),
    )


_ROWS = f"""
    SELECT page_id AS export_id, pos - 1 AS position, 'https://m.therou.example.com' || href || '/' AS source_url, text AS payload,
           CASE WHEN pos = 5 THEN substr(href, 2) ELSE coalesce(nullif(trim(text), ''), substr(href, 2)) END AS title
    FROM ({LINKS_SQL}) WHERE pos NOT IN (3, 4)
"""


@query(f"SELECT export_id, position, source_url, title, payload FROM ({_ROWS})")
def import_decode(spark, d):
    rows = I.build_rows(_raw_rows(spark, d))
    body = F.substring("payload", 5, 2**31 - 1)
    return rows.withColumn("payload", F.decode(body, "UTF-8"))


def _json_documents(spark, d):
    novel = lambda a, i: F.struct(
        a["href"].alias("LibStoryURL"), F.when(i != 1, a["text"]).alias("LibFilename"), F.lit("AAAA").alias("LibEpub")
    )
    document = F.to_json(F.struct(F.transform("links", novel).alias("Library")))
    broken = F.when(F.col("page_id") % 6 == 0, F.substring(document, 1, 40)).otherwise(document)
    return _links(spark, d).select(F.col("page_id").alias("export_id"), F.encode(broken, "UTF-8").alias("content"))


@query(f"""SELECT page_id AS export_id, pos - 1 AS position, href AS url, CASE WHEN pos <> 2 THEN text END AS file_name, 'AAAA' AS payload_text
           FROM ({LINKS_SQL}) WHERE page_id % 6 <> 0""")
def export_json(spark, d):
    return X.parse_json_exports(_json_documents(spark, d))


def _zip_documents(spark, d):
    """Each page's links packed as a ZIP export, folders numbered in tens.

    In every fifth the first file name is damaged; every eleventh is cut short.
    """
    def pack(batches):
        for batch in batches:
            out = []
            for page_id, links in zip(batch["page_id"], batch["links"]):
                box = io.BytesIO()
                with zipfile.ZipFile(box, "w") as archive:
                    archive.writestr("LibraryVersion.txt", "2")
                    for i, a in enumerate(links):
                        archive.writestr(f"Library/{i * 10}/LibStoryURL", a["href"])
                        if i != 1:
                            archive.writestr(f"Library/{i * 10}/LibFilename", a["text"])
                        archive.writestr(f"Library/{i * 10}/LibEpub", "AAAA")
                    first = archive.getinfo("Library/0/LibFilename") if len(links) else None
                data = bytearray(box.getvalue())
                if page_id % 5 == 0 and first is not None and first.file_size:
                    data[first.header_offset + 30 + len(first.filename)] ^= 1
                out.append((page_id, bytes(data[:60] if page_id % 11 == 3 else data)))
            yield pd.DataFrame(out, columns=["export_id", "content"])

    return _links(spark, d).mapInPandas(pack, "export_id long, content binary")


@query(f"""SELECT page_id AS export_id, (pos - 1) * 10 AS position, href AS url, CASE WHEN pos <> 2 AND NOT (pos = 1 AND page_id % 5 = 0) THEN text END AS file_name, 'AAAA' AS payload_text
           FROM ({LINKS_SQL}) WHERE page_id % 11 <> 3""")
def export_zip(spark, d):
    return X.parse_zip_exports(_zip_documents(spark, d))


@query(f"""SELECT page_id AS export_id, CASE WHEN page_id % 2 = 0 THEN (pos - 1) * 10 ELSE pos - 1 END AS position, href AS url
           FROM ({LINKS_SQL}) WHERE CASE WHEN page_id % 2 = 0 THEN page_id % 11 <> 3 ELSE page_id % 6 <> 0 END""")
def export_sniff(spark, d):
    both = _zip_documents(spark, d).filter("export_id % 2 = 0").unionByName(
        _json_documents(spark, d).filter("export_id % 2 = 1")
    )
    return X.parse_exports(both).select("export_id", "position", "url")


def _import_rows(spark, d):
    """Importable rows without payload; read several times, so tokenised once."""
    return checkpointed(I.build_rows(_raw_rows(spark, d)).drop("payload"))


def _known(rows):
    """Library rows for titles in a, e or i."""
    listed = rows.filter(F.lower(F.substring("title", 1, 1)).isin("a", "e", "i"))
    return listed.select(entry_id(F.col("source_url")).alias("id")).distinct()


# The library knows every URL that some export lists under a title in a, e or i;
# within an export the first row of a URL counts.
_MARKED = f"""
    SELECT r.*, r.source_url IN (SELECT source_url FROM ({_ROWS}) WHERE lower(title[1:1]) IN ('a', 'e', 'i'))
                OR row_number() OVER (PARTITION BY export_id, source_url ORDER BY position) > 1 AS skip FROM ({_ROWS}) r
"""


@query(f"SELECT export_id, position, skip FROM ({_MARKED})")
def import_skip(spark, d):
    rows = _import_rows(spark, d)
    return I.mark_skips(rows, _known(rows)).select("export_id", "position", "skip")


def _import_results(spark, d):
    listed = _import_rows(spark, d)
    rows = listed.withColumn(
        "source_url",
        F.when(F.col("export_id") % 2 == 0, F.col("source_url")).otherwise(
            F.replace("source_url", F.lit("m.therou.example.com"), F.lit("nowhere.test"))
        ),
    )
    failed = rows.filter("position = 0 and export_id % 10 = 0").select("export_id", "position")
    return I.import_results(I.mark_skips(rows, _known(listed), failed), rules_table(spark, CORPUS))


_RESULTS = f"""
    WITH r AS (SELECT *, source_url IN (SELECT source_url FROM ({_ROWS}) WHERE lower(title[1:1]) IN ('a', 'e', 'i')) AND export_id % 2 = 0 AS known,
                      position = 0 AND export_id % 10 = 0 AS bad FROM ({_ROWS})),
    f AS (SELECT *, min(CASE WHEN NOT bad AND NOT known THEN position END) OVER (PARTITION BY export_id, source_url) AS first_ok FROM r)
    SELECT export_id, position, CASE WHEN known THEN 'skipped' WHEN bad AND (first_ok IS NULL OR position < first_ok) THEN 'error'
           WHEN position = first_ok THEN 'imported' ELSE 'skipped' END AS status FROM f
"""


@query(f"""SELECT export_id, position, status, CASE WHEN export_id % 2 = 0 THEN 'therou' ELSE 'unknown' END AS parser,
                  CASE WHEN status = 'error' THEN 'write_failed' WHEN status = 'imported' AND export_id % 2 = 1 THEN 'unsupported_site' END AS detail
           FROM ({_RESULTS})""")
def import_status(spark, d):
    return _import_results(spark, d).select("export_id", "position", "status", "parser", "detail")


@query(f"""SELECT export_id, count(*) FILTER (status = 'imported') AS imported, count(*) FILTER (status = 'skipped') AS skipped,
                  count(*) FILTER (status = 'error') AS failed FROM ({_RESULTS}) GROUP BY export_id""")
def import_counts(spark, d):
    return I.import_counts(_import_results(spark, d))

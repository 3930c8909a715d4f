"""Book archives: writing volumes and reading documents in spine order."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from html import escape
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import slugify
from ..operators.books import CHAPTER_FILE, chapter_document
from .html_nodes import parse_nodes

PAGE = (
    '<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" lang="{lang}">'
    "<head><title>{title}</title></head><body>\n{body}\n</body></html>"
)
_CONTAINER = (
    '<?xml version="1.0"?><container version="1.0" '
    'xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles>'
    '<rootfile full-path="EPUB/content.opf" media-type="application/oebps-package+xml"/>'
    "</rootfiles></container>"
)
_EPOCH = (1980, 1, 1, 0, 0, 0)


def _write(archive: zipfile.ZipFile, name: str, data: str | bytes, method: int = zipfile.ZIP_DEFLATED) -> None:
    archive.writestr(zipfile.ZipInfo(name, _EPOCH), data, compress_type=method)


def contents_page(lang: str, listed: list[tuple[str, str]]) -> str:
    """The navigation document over (file name, title)."""
    links = "".join(f'<li><a href="{escape(name)}">{escape(title)}</a></li>' for name, title in listed)
    return PAGE.format(lang=escape(lang), title="Contents", body=f"<nav><ol>{links}</ol></nav>")


def _pack(head: dict, chapters: list[dict]) -> bytes:
    """One volume; equal input gives equal bytes."""
    lang = head["language"] or "en"
    documents = [("title", "text/title.xhtml", head["title"], head["document"])]
    documents += [
        (f"chapter_{c['position']:04d}", CHAPTER_FILE % c["position"], c["title"], c["document"]) for c in chapters
    ]
    fields = "".join(f"<dc:{p['key']}>{escape(p['value'])}</dc:{p['key']}>" for p in head["record"])
    items = '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>'
    items += "".join(
        f'<item id="{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n, _, _ in documents
    )
    if head["cover"] is not None:
        items += f'<item id="cover" href="{head["cover_file"]}" media-type="{escape(head["media_type"])}" properties="cover-image"/>'
    spine = "".join(f'<itemref idref="{i}"/>' for i in ["nav", *[d[0] for d in documents]])
    package = (
        '<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0">'
        f'<metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{fields}</metadata>'
        f"<manifest>{items}</manifest><spine>{spine}</spine></package>"
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        _write(archive, "mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        _write(archive, "META-INF/container.xml", _CONTAINER)
        for _, name, title, body in documents:
            _write(archive, f"EPUB/{name}", PAGE.format(lang=escape(lang), title=escape(title or ""), body=body))
        contents = contents_page(lang, [(name, title or "") for _, name, title, _ in documents[1:]])
        _write(archive, "EPUB/nav.xhtml", contents)
        _write(archive, "EPUB/content.opf", package)
        if head["cover"] is not None:
            _write(archive, f"EPUB/{head['cover_file']}", head["cover"], zipfile.ZIP_STORED)
    return out.getvalue()


_COVER = {"cover": "binary", "media_type": "string", "cover_file": "string"}


def pack_books(
    books: DataFrame, chapters: DataFrame, covers: DataFrame | None = None, numbered: bool = True
) -> DataFrame:
    """Archives from book heads and chapters, one row per (novel_id, volume).

    ``books`` has novel_id, title, language, title_page and record (the key /
    value pairs); ``chapters`` has novel_id, position, volume, title, html. The
    volume bounds a group, so a novel of any length is packed in pieces of
    limited size; ordinary novels have a single volume. Novels without
    chapters give no archive. Without ``numbered`` a position only orders the
    chapters of a volume, which are counted from 1 where they are packed: so
    bodies go through one shuffle. ``covers`` (novel_id, cover, media_type,
    cover_file) meets the heads alone; a book without one is complete all the same.
    """
    blank = [F.lit(None).cast(kind).alias(name) for name, kind in _COVER.items()]
    plain = books.select("*", *blank) if covers is None else books.join(covers, "novel_id", "left")

    def head_rows(keyed: DataFrame) -> DataFrame:
        return keyed.select(
            "novel_id", "volume", F.lit(0).cast("long").alias("position"), "title",
            F.col("title_page").alias("document"), "language", "record", *_COVER,
        )

    body = chapters.select(
        "novel_id", "volume", F.col("position").cast("long").alias("position"), "title",
        chapter_document(F.col("title"), F.col("html")).alias("document"),
        F.lit(None).cast("string").alias("language"),
        F.lit(None).cast(books.schema["record"].dataType).alias("record"),
        *blank,
    )
    # Heads ride along as row 0 of each volume. Volume 0 needs no lookup; the
    # further ones exist only for books beyond the limit.
    more = chapters.filter("volume > 0").select("novel_id", "volume").distinct()
    rows = body.unionByName(head_rows(plain.withColumn("volume", F.lit(0)))).unionByName(
        head_rows(more.join(plain, "novel_id"))
    )

    kind = chapters.schema["novel_id"].dataType.simpleString()
    result = f"novel_id {kind}, volume int, chapter_count long, payload binary"
    arrow_result = to_arrow_schema(T._parse_datatype_string(result))

    def pack(group: pa.Table) -> pa.Table:
        head, *packed = sorted(group.to_pylist(), key=lambda r: (r["record"] is None, r["position"]))
        if not numbered:
            for at, chapter in enumerate(packed, 1):
                chapter["position"] = at
        volumes = []
        if packed:
            volumes.append(
                {"novel_id": head["novel_id"], "volume": head["volume"], "chapter_count": len(packed),
                 "payload": _pack(head, packed)}
            )
        return pa.Table.from_pylist(volumes, schema=arrow_result)

    # Compression is bound by CPU, not bytes: keep the partitions that adaptive
    # execution would merge by size.
    parts = int(books.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "novel_id", "volume").groupBy("novel_id", "volume").applyInArrow(pack, result)


def archive_names(archives: DataFrame, books: DataFrame) -> DataFrame:
    """File name of each archive; further volumes carry their number."""
    slug = slugify(F.col("title"))
    suffix = F.when(F.col("volume") > 0, F.concat(F.lit(".vol"), (F.col("volume") + 1).cast("string"))).otherwise(F.lit(""))
    return archives.join(books.select("novel_id", "title"), "novel_id").withColumn(
        "file_name", F.concat(slug, suffix, F.lit(".epub"))
    ).drop("title")


@dataclass
class Package:
    """What an archive says of itself: its package document and the documents in reading order, navigation left out."""

    path: str
    text: str
    root: str
    language: str
    nav: str | None
    ncx: str | None
    ids: set[str]
    documents: list[tuple[int, str, str | None]]  # reading position from 1, file name, title in the contents list

    def member(self, href: str) -> str:
        return posixpath.normpath(posixpath.join(self.root, href))


def _local(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def read_package(archive: zipfile.ZipFile) -> Package:
    box = ElementTree.fromstring(archive.read("META-INF/container.xml"))
    opf = next(e.get("full-path") for e in box.iter() if e.tag.endswith("rootfile"))
    raw = archive.read(opf)
    package = ElementTree.fromstring(raw)
    items = {e.get("id"): e for e in package.iter() if _local(e) == "item"}
    nav = next((e.get("href") for e in items.values() if "nav" in (e.get("properties") or "").split()), None)
    ncx = next((e.get("href") for e in items.values() if e.get("media-type") == "application/x-dtbncx+xml"), None)
    language = next((e.text for e in package.iter() if _local(e) == "language" and e.text), "en")
    found = Package(opf, raw.decode("utf-8", "replace"), posixpath.dirname(opf), language, nav, ncx, set(items), [])
    titles: dict[str, str] = {}
    if nav is not None:
        titles = _contents(archive.read(found.member(nav)).decode("utf-8", "replace"))
    elif ncx is not None:
        titles = _points(archive.read(found.member(ncx)))
    for ref in [e.get("idref") for e in package.iter() if _local(e) == "itemref"]:
        item = items.get(ref)
        if item is None or item.get("media-type") != "application/xhtml+xml" or item.get("href") == nav:
            continue
        found.documents.append((len(found.documents) + 1, item.get("href"), titles.get(item.get("href"))))
    return found


def _documents(content: bytes) -> list[tuple]:
    """(spine position, file name, title, html) of all documents, navigation left out.

    All or nothing: an archive with one unreadable document has none.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            package = read_package(archive)
            return [
                (at, href, title, archive.read(package.member(href)).decode("utf-8", "replace"))
                for at, href, title in package.documents
            ]
    except Exception:  # noqa: BLE001 - no archive may end a job
        return []


def _points(ncx: bytes) -> dict[str, str]:
    """href -> title of an NCX document."""
    found: dict[str, str] = {}
    for point in ElementTree.fromstring(ncx).iter():
        if _local(point) == "navPoint":
            text = next((e.text for e in point.iter() if _local(e) == "text"), None)
            source = next((e.get("src") for e in point.iter() if _local(e) == "content"), None)
            if source and text:
                found.setdefault(source, text.strip())
    return found


def _contents(html: str) -> dict[str, str]:
    """href -> title of a contents document."""
    nodes = parse_nodes(html)
    found: dict[str, str] = {}
    for row in nodes:
        if row[5] == "a" and row[6].get("href"):
            text = "".join(n[7] for n in nodes[row[0]:row[2]] if n[4] == "tx")
            found.setdefault(row[6]["href"], text.strip())
    return found


def unreadable_archives(df: DataFrame, documents: DataFrame) -> DataFrame:
    """Archives without documents: damaged ones, and ones that hold none."""
    return df.select("archive_id").join(documents, "archive_id", "left_anti").withColumn(
        "detail", F.lit("unreadable_archive")
    )


def explode_archives(df: DataFrame) -> DataFrame:
    """Archives (archive_id, payload) to documents in reading order.

    ``toc_title`` is the title in the archive's own contents list.
    """
    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["archive_id", "spine", "file_name", "toc_title", "html"]
        for batch in batches:
            for archive_id, payload in zip(batch["archive_id"], batch["payload"]):
                rows = [(archive_id, *d) for d in _documents(bytes(payload))]
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    kind = df.schema["archive_id"].dataType.simpleString()
    return df.select("archive_id", "payload").mapInPandas(
        explode, f"archive_id {kind}, spine int, file_name string, toc_title string, html string"
    )

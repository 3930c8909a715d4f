"""Chapters appended to stored archives without unpacking what they hold.

An append has three parts, so that no task does more than its share of a large update:

1. ``read_manifests``: the documents of each archive as rows. Names and places of new chapters are then a
   matter of joins (``operators.books.append_names``).
2. ``packed_members``: each new document is deflated on its own, in whatever task holds it.
3. ``splice``: the packed bytes of the old members are copied as they stand, the new members are put behind them,
   and the contents list, the package document and the directory are written anew.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from html import escape
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.books import append_names, chapter_document
from .archives import PAGE, Package, contents_page, read_package

# ---- fixed values: the ZIP format ----------------------------------------
_LOCAL, _ENTRY, _END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
_END64, _LOCATOR64 = b"PK\x06\x06", b"PK\x06\x07"
_ENCRYPTED, _SIZES_BEHIND, _UTF8 = 1 << 0, 1 << 3, 1 << 11
#: 1980-01-01 00:00, as the archive writer has it.
_STAMP = 0x00210000
# --------------------------------------------------------------------------


@dataclass
class Member:
    """One member with its bytes as they stand in the archive."""

    name: bytes
    method: int
    crc: int
    size: int
    packed: bytes
    flags: int = _UTF8
    stamp: int = _STAMP
    attributes: int = 0


def old_members(content: bytes, archive: zipfile.ZipFile) -> list[Member]:
    """All members in the order in which they lie; an encrypted one is refused."""
    found = []
    for info in sorted(archive.infolist(), key=lambda i: i.header_offset):
        if info.flag_bits & _ENCRYPTED:
            raise ValueError("encrypted member")
        at = info.header_offset
        if content[at : at + 4] != _LOCAL:
            raise ValueError("no local header")
        (stamp,) = struct.unpack_from("<I", content, at + 10)
        name, extra = struct.unpack_from("<HH", content, at + 26)
        start = at + 30 + name + extra
        packed = content[start : start + info.compress_size]
        if len(packed) != info.compress_size:
            raise ValueError("member cut short")
        raw = content[at + 30 : at + 30 + name]
        found.append(
            Member(raw, info.compress_type, info.CRC, info.file_size, packed, info.flag_bits & ~_SIZES_BEHIND, stamp, info.external_attr)
        )
    return found


def deflated(name: str, data: bytes) -> Member:
    return Member(name.encode(), zipfile.ZIP_DEFLATED, zlib.crc32(data), len(data), _deflate(data))


def _deflate(data: bytes) -> bytes:
    packer = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -zlib.MAX_WBITS)
    return packer.compress(data) + packer.flush()


def written(members: list[Member]) -> bytes:
    """An archive of these members; the long form of the directory's end is used past 65,535 of them."""
    parts, entries, at = [], [], 0
    for m in members:
        shared = struct.pack("<HHIIIIHH", m.flags, m.method, m.stamp, m.crc, len(m.packed), m.size, len(m.name), 0)
        local = _LOCAL + struct.pack("<H", 20) + shared + m.name
        entries.append(_ENTRY + struct.pack("<HH", 20, 20) + shared + struct.pack("<HHHII", 0, 0, 0, m.attributes, at) + m.name)
        parts += [local, m.packed]
        at += len(local) + len(m.packed)
    directory = b"".join(entries)
    count, end = len(members), b""
    if count > 0xFFFF:
        end = _END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, len(directory), at)
        end += _LOCATOR64 + struct.pack("<IQI", 0, at + len(directory), 1)
    short = min(count, 0xFFFF)
    end += _END + struct.pack("<HHHHIIH", 0, 0, short, short, len(directory), at, 0)
    return b"".join([*parts, directory, end])


def _before_end(xml: str, name: str, added: str) -> str:
    """``added`` put before the last end tag of ``name``; ``{p}`` in it stands for that tag's prefix."""
    ends = list(re.finditer(rf"</((?:[\w.-]+:)?){name}\s*>", xml))
    if not ends:
        raise ValueError(f"no end of {name}")
    return xml[: ends[-1].start()] + added.replace("{p}", ends[-1][1]) + xml[ends[-1].start() :]


def _with_items(package: Package, fresh: list[dict]) -> tuple[str, str | None]:
    """The package document with the new chapters, and the navigation document's name if it had none."""
    ids, items, refs = set(package.ids), "", ""
    for row in fresh:
        name = re.sub(r".*/|\.xhtml$", "", row["file_name"])
        while name in ids:
            name += "_"
        ids.add(name)
        items += f'<{{p}}item id="{name}" href="{row["file_name"]}" media-type="application/xhtml+xml"/>'
        refs += f'<{{p}}itemref idref="{name}"/>'
    nav = None
    if package.nav is None:
        nav = "contents.xhtml"
        while any(nav == href for _, href, _ in package.documents):
            nav = f"_{nav}"
        items += f'<{{p}}item id="{_free("contents", ids)}" href="{nav}" media-type="application/xhtml+xml" properties="nav"/>'
    text = _before_end(_before_end(package.text, "manifest", items), "spine", refs)
    ElementTree.fromstring(text.encode())
    return text, nav


def _free(name: str, taken: set[str]) -> str:
    while name in taken:
        name += "_"
    return name


def _with_points(ncx: str, fresh: list[dict]) -> str:
    order = len(re.findall(r"<(?:[\w.-]+:)?navPoint\b", ncx))
    points = "".join(
        f'<{{p}}navPoint id="added_{order + i}" playOrder="{order + i}"><{{p}}navLabel><{{p}}text>{_plain(row["title"])}'
        f'</{{p}}text></{{p}}navLabel><{{p}}content src="{row["file_name"]}"/></{{p}}navPoint>'
        for i, row in enumerate(fresh, 1)
    )
    return _before_end(ncx, "navMap", points)


def _plain(title: str | None) -> str:
    """A title as text in which no brace can be taken for a prefix."""
    return escape(title or "").replace("{", "&#123;")


def spliced(content: bytes, fresh: list[dict]) -> bytes:
    """An archive with new members (file_name, title, crc, size, packed) behind its own.

    Contents list titles of old documents are those it had, else file names.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        package = read_package(archive)
        members = old_members(content, archive)
        text, new_nav = _with_items(package, fresh)
        ncx = archive.read(package.member(package.ncx)).decode() if package.ncx else None
    nav = package.member(package.nav or new_nav)
    listed = [(href, title or href) for _, href, title in package.documents if href != "text/title.xhtml"]
    listed += [(row["file_name"], row["title"] or row["file_name"]) for row in fresh]
    rewritten = {nav: contents_page(package.language, listed), package.path: text}
    if ncx is not None:
        rewritten[package.member(package.ncx)] = _with_points(ncx, fresh)
    taken = {m.name.decode("utf-8", "replace") for m in members}
    added = [
        Member(package.member(row["file_name"]).encode(), zipfile.ZIP_DEFLATED, row["crc"], row["size"], row["packed"]) for row in fresh
    ]
    if any(m.name.decode() in taken for m in added):
        raise ValueError("a member of that name exists")
    kept = [m for m in members if m.name.decode("utf-8", "replace") not in rewritten]
    return written([*kept, *added, *(deflated(name, data.encode()) for name, data in rewritten.items())])


def read_manifests(archives: DataFrame) -> DataFrame:
    """(archive_id, spine, file_name, title, language) of archives (archive_id, payload).

    Row 0 of an archive stands for the archive itself; one that cannot be read has no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, payload in enumerate(batch.column("payload").to_pylist()):
                try:
                    with zipfile.ZipFile(io.BytesIO(payload)) as archive:
                        package = read_package(archive)
                except Exception:  # noqa: BLE001 - no archive may end a job
                    continue
                found = [(0, None, None), *((at, href, title or href) for at, href, title in package.documents)]
                ids += [i] * len(found)
                rows += [(*row, package.language) for row in found]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("archive_id").take(pa.array(ids, pa.int64())), *(
                    pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)
                )],
                ["archive_id", "spine", "file_name", "title", "language"],
            )

    kind = archives.schema["archive_id"].dataType.simpleString()
    return archives.select("archive_id", "payload").mapInArrow(
        read, f"archive_id {kind}, spine int, file_name string, title string, language string"
    )


def packed_members(documents: DataFrame) -> DataFrame:
    """Documents (archive_id, spine, file_name, title, language, document) as members ready to be copied."""
    page = [F.lit(part) for part in re.split(r"\{\w+\}", PAGE)]
    name = F.replace(F.replace(F.replace(F.coalesce("title", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    text = F.concat(page[0], F.col("language"), page[1], name, page[2], F.col("document"), page[3])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("data").to_pylist()
            columns = [batch.column(c) for c in ("archive_id", "spine", "file_name", "title")]
            yield pa.RecordBatch.from_arrays(
                [
                    *columns, pa.array([zlib.crc32(d) for d in data], pa.int64()), pa.array([len(d) for d in data], pa.int64()),
                    pa.array([_deflate(d) for d in data], pa.binary()),
                ],
                ["archive_id", "spine", "file_name", "title", "crc", "size", "packed"],
            )

    kind = documents.schema["archive_id"].dataType.simpleString()
    rows = documents.select("archive_id", F.col("spine").cast("long").alias("spine"), "file_name", "title", text.cast("binary").alias("data"))
    return rows.mapInArrow(packed, f"archive_id {kind}, spine long, file_name string, title string, crc long, size long, packed binary")


def splice(archives: DataFrame, members: DataFrame) -> DataFrame:
    """(archive_id, payload, added, detail): each archive with its members behind; a null payload has a ``detail``."""
    kind = archives.schema["archive_id"].dataType.simpleString()
    result = T._parse_datatype_string(f"archive_id {kind}, payload binary, added int, detail string")
    arrow = to_arrow_schema(result)

    def joined(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        row = {"archive_id": key[0].as_py(), "payload": None, "added": 0, "detail": "epub_file_missing"}
        if left.num_rows:
            fresh = right.sort_by("spine").to_pylist()
            try:
                if not fresh:
                    raise ValueError("no manifest")
                row |= {"payload": spliced(left.column("payload")[0].as_py(), fresh), "added": len(fresh), "detail": None}
            except Exception:  # noqa: BLE001 - no archive may end a job
                row["detail"] = "unreadable_archive"
        return pa.Table.from_pylist([row], schema=arrow)

    pairs = archives.select("archive_id", "payload").groupBy("archive_id").cogroup(members.groupBy("archive_id"))
    return pairs.applyInArrow(joined, result)


def append_to_archives(archives: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rewritten archives (archive_id, payload, added, detail), only those with new chapters.

    ``archives`` has archive_id and payload, a row each; ``fresh`` has archive_id, position (from 1 in each archive),
    title and html. An archive that is not there or cannot be read has a null payload and a ``detail``.
    """
    wanted = fresh.select("archive_id").distinct()
    touched = archives.join(wanted, "archive_id", "left_semi")
    manifest = read_manifests(touched)
    named = append_names(manifest.withColumnRenamed("archive_id", "novel_id"), fresh.withColumnRenamed("archive_id", "novel_id"))
    languages = manifest.filter("spine = 0").select(F.col("archive_id").alias("novel_id"), "language")
    title = F.coalesce("title", F.lit(""))
    documents = named.join(languages, "novel_id").select(
        F.col("novel_id").alias("archive_id"), "spine", "file_name", title.alias("title"), "language",
        chapter_document(title, F.coalesce("html", F.lit(""))).alias("document"),
    )
    made = splice(touched, packed_members(documents))
    missing = wanted.join(archives.select("archive_id"), "archive_id", "left_anti").select(
        "archive_id", F.lit(None).cast("binary").alias("payload"), F.lit(0).alias("added"), F.lit("epub_file_missing").alias("detail")
    )
    return made.unionByName(missing)


def list_members(archives: DataFrame) -> DataFrame:
    """(archive_id, member, method, size, packed_sha256): members with the digest of their bytes as they stand."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, payload in enumerate(batch.column("payload").to_pylist()):
                try:
                    with zipfile.ZipFile(io.BytesIO(payload)) as archive:
                        members = old_members(payload, archive)
                except Exception:  # noqa: BLE001 - no archive may end a job
                    continue
                ids += [i] * len(members)
                rows += [(m.name.decode("utf-8", "replace"), m.method, m.size, hashlib.sha256(m.packed).hexdigest()) for m in members]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("archive_id").take(pa.array(ids, pa.int64())), *(
                    pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.string()), strict=True)
                )],
                ["archive_id", "member", "method", "size", "packed_sha256"],
            )

    kind = archives.schema["archive_id"].dataType.simpleString()
    return archives.select("archive_id", "payload").mapInArrow(
        listed, f"archive_id {kind}, member string, method int, size long, packed_sha256 string"
    )

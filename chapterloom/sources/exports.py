"""Third-party library exports, in their ZIP and their JSON form."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.imports import is_zip

# The keys of one exported novel.
KEYS = ("LibStoryURL", "LibFilename", "LibEpub")
RAW_COLUMNS = ["export_id", "position", "url", "file_name", "payload_text"]


def parse_json_exports(df: DataFrame) -> DataFrame:
    """JSON documents (export_id, content BINARY) to raw rows; bad documents have none."""
    row = "struct<LibStoryURL:string,LibFilename:string,LibEpub:string>"
    text = F.try_validate_utf8(F.col("content").cast("string"))
    # Novels are split as raw text first: one odd row must not spoil the others.
    novels = F.from_json(text, "struct<Library:array<string>>")["Library"]
    exploded = df.select("export_id", F.posexplode(novels).alias("_p", "_raw"))
    parsed = exploded.withColumn("_n", F.from_json("_raw", row)).filter("_n is not null")
    return parsed.select(
        "export_id", F.col("_p").alias("position"), *[F.col(f"_n.{k}").alias(n) for k, n in zip(KEYS, RAW_COLUMNS[2:])]
    )


MEMBERS = "export_id {id}, member string, text string, status string"


def zip_members(df: DataFrame) -> DataFrame:
    """Every member of ZIP documents (export_id, content BINARY), with a status.

    ``ok``; ``unreadable`` for a member that is damaged, encrypted or packed in an unknown way; a document that is no
    archive is one row without a member, ``no_archive``.
    """
    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for export_id, content in zip(batch["export_id"], batch["content"]):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as archive:
                        for info in archive.infolist():
                            try:
                                rows.append((export_id, info.filename, archive.read(info).decode("utf-8", "replace"), "ok"))
                            except Exception:  # noqa: BLE001 - no member may end a job
                                rows.append((export_id, info.filename, None, "unreadable"))
                except Exception:  # noqa: BLE001 - nor may an archive
                    rows = [(export_id, None, None, "no_archive")]
                yield pd.DataFrame(rows, columns=["export_id", "member", "text", "status"])

    kind = df.schema["export_id"].dataType.simpleString()
    return df.select("export_id", "content").mapInPandas(listed, MEMBERS.format(id=kind))


def parse_zip_exports(df: DataFrame) -> DataFrame:
    """ZIP documents to raw rows: the number and the key come from a member's path, keys become columns.

    A folder counts as soon as one member lies in it; unreadable values are null.
    """
    place = F.regexp_extract("member", r"^Library/(\d+)/(.*)", 1)
    key = F.regexp_extract("member", r"^Library/(\d+)/(.*)", 2)
    named = zip_members(df).filter("member is not null").select(
        "export_id", place.try_cast("int").alias("position"), key.alias("key"), "text"
    )
    return named.filter("position is not null").groupBy("export_id", "position").agg(
        *[F.max(F.when(F.col("key") == k, F.col("text"))).alias(n) for k, n in zip(KEYS, RAW_COLUMNS[2:])]
    )


def parse_exports(df: DataFrame) -> DataFrame:
    """Either form, told apart by the first four bytes."""
    zipped = F.coalesce(is_zip(F.col("content")), F.lit(False))
    return parse_zip_exports(df.filter(zipped)).unionByName(parse_json_exports(df.filter(~zipped)))


def unreadable_exports(df: DataFrame, usable: DataFrame) -> DataFrame:
    """Exports without a single readable novel: the whole import is an error."""
    return df.select("export_id").join(usable, "export_id", "left_anti").withColumn(
        "detail", F.lit("import_error")
    )

"""Import of third-party library exports: decode, skip, status, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import strip
from ..functions.urls import entry_id
from .routing import route

# ---- fixed values -------------------------------------------------------
ZIP_MAGIC = "504B0304"
DATA_URI = r"(?i)^data:[^;,]*;base64,"
# -------------------------------------------------------------------------


def is_zip(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 4)) == ZIP_MAGIC


def decode_payload(value: Column) -> Column:
    """Stored book bytes with or without data URI prefix; null when it is no archive."""
    text = F.regexp_replace(strip(value), DATA_URI, "")
    # Characters outside the alphabet are skipped, as lenient decoders do.
    clean = F.regexp_replace(text, "[^A-Za-z0-9+/=]", "")
    payload = F.try_to_binary(clean, F.lit("base64"))
    return F.when(is_zip(payload), payload)


def build_rows(raw: DataFrame) -> DataFrame:
    """Raw rows (export_id, position, url, file_name, payload_text) to importable ones.

    A row needs a URL and a readable payload; the title falls back to the last
    segment of the URL. Bad rows drop out one by one.
    """
    usable = raw.filter((F.col("url") != "") & (F.col("payload_text") != ""))
    last_segment = F.regexp_extract(F.regexp_replace("url", "/+$", ""), "([^/]*)$", 1)
    title = F.coalesce(F.nullif(strip(F.col("file_name")), F.lit("")), last_segment)
    return (
        usable.withColumn("payload", decode_payload(F.col("payload_text")))
        .filter(F.col("payload").isNotNull())
        .select("export_id", "position", strip(F.col("url")).alias("source_url"), title.alias("title"), "payload")
    )


def mark_skips(rows: DataFrame, library: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Append ``id`` and ``skip``: ids already known, or seen earlier in the same export.

    The first position per id comes from a combined aggregate and is joined
    back on (id, position), so copies of one novel never gather in one task.
    ``failed`` (export_id, position) names rows that could not be written;
    those do not make later copies known.
    """
    rows = rows.withColumn("id", entry_id(F.col("source_url")))
    usable = rows if failed is None else rows.join(failed, ["export_id", "position"], "left_anti")
    new = usable.join(library.select("id"), "id", "left_anti")
    first = new.groupBy("export_id", "id").agg(F.min("position").alias("_first"))
    keep = first.select("export_id", "id", F.col("_first").alias("position"), F.lit(True).alias("_keep"))
    marked = rows.join(keep, ["export_id", "id", "position"], "left")
    if failed is None:
        return marked.withColumn("skip", F.col("_keep").isNull()).drop("_keep")
    # A failed row is an error only while its id is still unknown at that point.
    bad = (
        rows.join(failed, ["export_id", "position"], "left_semi")
        .join(library.select("id"), "id", "left_anti")
        .join(first, ["export_id", "id"], "left")
        .filter(F.col("_first").isNull() | (F.col("position") < F.col("_first")))
        .select("export_id", "id", "position", F.lit(True).alias("_bad"))
    )
    return (
        marked.join(bad, ["export_id", "id", "position"], "left")
        .withColumn("failed", F.coalesce("_bad", F.lit(False)))
        .withColumn("skip", F.col("_keep").isNull() & ~F.col("failed"))
        .drop("_keep", "_bad")
    )


def import_results(marked: DataFrame, rules: DataFrame) -> DataFrame:
    """Outcome per row: imported, skipped or error; sites we cannot update are flagged."""
    routed = route(marked, rules, "source_url").drop("host")
    if "failed" not in routed.columns:
        routed = routed.withColumn("failed", F.lit(False))
    status = (
        F.when(F.col("failed"), F.lit("error")).when(F.col("skip"), F.lit("skipped")).otherwise(F.lit("imported"))
    )
    return (
        routed.withColumn("status", status)
        .withColumn(
            "detail",
            F.when(F.col("status") == "error", F.lit("write_failed"))
            .when((F.col("status") == "imported") & F.col("site").isNull(), F.lit("unsupported_site")),
        )
        .withColumn("parser", F.coalesce("site", F.lit("unknown")))
        .drop("skip", "failed", "site")
    )


def import_counts(results: DataFrame) -> DataFrame:
    """Totals per export."""
    return results.groupBy("export_id").agg(
        F.count_if(F.col("status") == "imported").alias("imported"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "error").alias("failed"),
    )


def library_rows(results: DataFrame, at: Column) -> DataFrame:
    """New library entries of an import; the count is the archive's own."""
    return results.filter("status = 'imported'").select(
        "id", "source_url", "parser", "title",
        F.lit("Unknown").alias("author"), F.lit("en").alias("language"),
        F.lit(None).cast("string").alias("cover_url"), "file_path", "chapter_count",
        F.lit(None).cast("string").alias("last_chapter_url"),
        at.alias("created_at"), at.alias("updated_at"),
    )

"""Library and settings files, and versioned snapshots of keyed tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .commits import CommitLog

ENTRY_TYPE = T.StructType(
    [
        T.StructField(name, T.IntegerType() if name == "chapter_count" else T.StringType())
        for name in (
            "id source_url parser title author language cover_url file_path chapter_count "
            "last_chapter_url created_at updated_at"
        ).split()
    ]
)
REQUIRED = ("id", "source_url", "parser", "title", "created_at", "updated_at")

RUN_TYPE = T.StructType(
    [
        T.StructField(name, T.IntegerType() if name in ("checked", "updated", "failed") else T.StringType())
        for name in "started_at finished_at trigger status checked updated failed".split()
    ]
)
# What counts as a truth value in a stored setting.
YES = ("true", "1", "yes", "y", "on", "t")
NO = ("false", "0", "no", "n", "off", "f")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files as (path, content); a missing path gives no rows."""
    try:
        return spark.read.text(path, wholetext=True).select(
            F.input_file_name().alias("path"), F.col("value").alias("content")
        )
    except Exception as error:  # a path that does not exist is "not there yet"
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "path string, content string")


def library_entries(documents: DataFrame, keys: list[str], content: Column) -> DataFrame:
    """Entries of library documents; a corrupt document has none, bad rows drop one by one."""
    # Entries are split as raw text first, so a malformed one cannot spoil its neighbours.
    items = F.from_json(content, "struct<entries:array<string>>")["entries"]
    rows = documents.select(*keys, F.posexplode(items).alias("position", "_raw"))
    entry = F.from_json("_raw", ENTRY_TYPE)
    whole = F.from_json("_raw", "map<string,string>")
    parsed = rows.withColumn("_e", entry).withColumn("_m", whole)
    sound = F.col("_e").isNotNull()
    for name in REQUIRED:
        sound &= F.col(f"_e.{name}").isNotNull()
    # A count that is present but is no number makes the row malformed.
    sound &= F.col("_e.chapter_count").isNotNull() | ~F.map_contains_key("_m", F.lit("chapter_count"))
    defaults = {"author": "Unknown", "language": "en", "chapter_count": 0}
    return parsed.filter(sound).select(
        *keys,
        "position",
        *[
            F.coalesce(f"_e.{f.name}", F.lit(defaults[f.name])).alias(f.name)
            if f.name in defaults else F.col(f"_e.{f.name}").alias(f.name)
            for f in ENTRY_TYPE
        ],
    )


#: Entries per document: no document grows with the library.
DOCUMENT_ENTRIES = 1000


def library_documents(library: DataFrame, keys: list[str]) -> DataFrame:
    """Entries as versioned JSON documents of at most a thousand entries each.

    ``library`` has ``position`` (0-based list order) beside the entry columns;
    ``part`` numbers the documents of a library. ``library_entries`` reads them.
    """
    fields = [f.name for f in ENTRY_TYPE]
    part = F.floor(F.col("position") / DOCUMENT_ENTRIES)
    grouped = library.groupBy(*keys, part.alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("position", F.struct(*fields).alias("e")))).alias("_rows")
    )
    entries = F.transform("_rows", lambda r: r["e"]).alias("entries")
    document = F.to_json(F.struct(F.lit(1).alias("version"), entries), {"ignoreNullFields": "false"})
    return grouped.select(*keys, "part", document.alias("content"))


def _whole(text: Column) -> Column:
    """A whole number, also if it is stored as text or with a fraction of zero; null for anything else."""
    number = F.trim(text).try_cast("decimal(20,6)")
    return F.when(number == F.floor(number), number.cast("int"))


def _truth(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin(*YES), F.lit(True)).when(low.isin(*NO), F.lit(False))


def settings_rows(documents: DataFrame, keys: list[str], content: Column) -> DataFrame:
    """One settings row per document; anything invalid falls back to all defaults.

    Values are taken as they are meant: 24, 24.0 and "24" are the same interval, true, 1 and "yes" the same switch.
    """
    raw = F.from_json(F.get_json_object(content, "$.settings"), "map<string,string>")

    def setting(name: str, read: Callable[[Column], Column]) -> tuple[Column, Column]:
        """The value, and whether one is there that cannot be read."""
        value = read(raw[name])
        return value, F.coalesce(F.map_contains_key(raw, F.lit(name)), F.lit(False)) & value.isNull()

    enabled, odd_enabled = setting("auto_update_enabled", _truth)
    interval, odd_interval = setting("auto_update_interval_hours", _whole)
    startup, odd_startup = setting("check_on_startup", _truth)
    hours = F.coalesce(interval, F.lit(24))
    bad = raw.isNull() | odd_enabled | odd_interval | odd_startup | (hours < 1)
    return documents.select(
        *keys,
        F.when(bad, F.lit(False)).otherwise(F.coalesce(enabled, F.lit(False))).alias("enabled"),
        F.when(bad, F.lit(24)).otherwise(hours).alias("interval_hours"),
        F.when(bad, F.lit(False)).otherwise(F.coalesce(startup, F.lit(False))).alias("check_on_startup"),
    )


def run_rows(documents: DataFrame, keys: list[str], content: Column) -> DataFrame:
    """Run log rows in append order (``seq`` from 1); bad rows drop, defaults fill in."""
    items = F.from_json(content, "struct<runs:array<string>>")["runs"]
    rows = documents.select(*keys, F.posexplode(items).alias("_p", "_raw"))
    parsed = rows.withColumn("_r", F.from_json("_raw", RUN_TYPE))
    sound = F.col("_r").isNotNull()
    for name in ("started_at", "finished_at", "trigger"):
        sound &= F.col(f"_r.{name}").isNotNull()
    defaults = {"status": "ok", "checked": 0, "updated": 0, "failed": 0}
    return parsed.filter(sound).select(
        *keys,
        (F.col("_p") + 1).alias("seq"),
        *[
            F.coalesce(f"_r.{f.name}", F.lit(defaults[f.name])).alias(f.name)
            if f.name in defaults else F.col(f"_r.{f.name}").alias(f.name)
            for f in RUN_TYPE
        ],
    )


class Snapshots:
    """A keyed table as immutable snapshot folders and a log of commits that name them.

    A write goes to a new folder, which is then committed under the next number; readers see the old snapshot or the new one, and
    a lost job leaves only an unreferenced folder behind. The path being read is never overwritten. A write belongs to the
    snapshot that was last read or written here; if another one has been committed since, the
    write is refused and the new folder stays unreferenced.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, f"{self.root}/_log")
        self.known: int | None = None

    def current(self) -> str | None:
        return self.log.latest()[1].get("name")

    def _rows(self, name: str | None, schema: T.StructType) -> DataFrame:
        if name is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def read(self, schema: T.StructType) -> DataFrame:
        self.known, content = self.log.latest()
        return self._rows(content.get("name"), schema)

    def at(self, version: int, schema: T.StructType) -> DataFrame:
        """The table as one of the commits has it."""
        return self._rows(self.log.content(version)["name"], schema)

    def write(self, df: DataFrame, name: str | None = None) -> str:
        """Write a snapshot and make it current; a ``name`` that is current already is not written again."""
        version, content = self.log.latest()
        if name is not None and content.get("name") == name:
            return name
        name = name or f"snapshot-{uuid.uuid4().hex}"
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        version = version if self.known is None else self.known
        self.log.publish(version + 1, {"name": name})
        self.known = version + 1
        return name

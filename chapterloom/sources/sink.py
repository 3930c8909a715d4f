"""Book files as a data source that can be written: one file a row, all of a job's files or none.

``df.write.format("book_files").option("path", folder)`` takes rows of (file_name, payload). A task writes its files
under names of the job's own, beside a list of them. When all tasks are done, one commit moves the files to
their names and keeps the lists under ``_saved/<run>``; a job that fails is aborted and leaves nothing but what was there.
Files of repeated or lost attempts are never listed, and go with the job's own folder.

A book that cannot be written does not fail the job: its list entry has no path.

The folder is one that all executors reach: a path, or a URI of a store that Arrow's file systems know.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

SAVED_SCHEMA = "file_name string, saved_path string"
#: Files that one commit moves at once.
MOVERS = 16


@dataclass
class Listed(WriterCommitMessage):
    """The list that a task has left; None if it could not write at all."""

    name: str | None


class BookWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, run: str) -> None:
        self.folder, self.run = folder.rstrip("/"), run

    def _open(self) -> tuple[fs.FileSystem, str, str]:
        store, root = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)
        return store, root, f"{root}/_staged-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Listed:
        store, _, staged = self._open()
        mark = uuid.uuid4().hex
        try:
            store.create_dir(staged)
        except OSError:
            for _ in iterator:
                pass
            return Listed(None)
        at = 0
        with store.open_output_stream(f"{staged}/{mark}.list") as names:
            for batch in iterator:
                for name, payload in zip(batch.column("file_name").to_pylist(), batch.column("payload"), strict=True):
                    part = f"{mark}-{at}"
                    at += 1
                    try:
                        if not name or "/" in name or name in (".", "..") or not payload.is_valid:
                            raise OSError(f"no file name or no content: {name}")
                        with store.open_output_stream(f"{staged}/{part}") as out:
                            out.write(payload.as_buffer())
                    except OSError:
                        part = None
                    names.write(json.dumps([name, part]).encode() + b"\n")
        return Listed(mark)

    def commit(self, messages: list[Listed | None]) -> None:
        store, root, staged = self._open()
        marks = [m.name for m in messages if m is not None and m.name is not None]
        if not marks:
            return

        def moved(entry: list) -> dict:
            name, part = entry
            path = None
            if part is not None:
                try:
                    store.move(f"{staged}/{part}", f"{root}/{name}")
                    path = f"{self.folder}/{name}"
                except OSError:
                    pass
            return {"file_name": name, "saved_path": path}

        store.create_dir(f"{root}/_saved/{self.run}")
        with ThreadPoolExecutor(MOVERS) as pool:
            for mark in marks:
                with store.open_input_stream(f"{staged}/{mark}.list") as names:
                    entries = [json.loads(line) for line in names.read().splitlines()]
                done = "".join(json.dumps(x) + "\n" for x in pool.map(moved, entries))
                with store.open_output_stream(f"{root}/_saved/{self.run}/{mark}.json") as out:
                    out.write(done.encode())
        store.delete_dir(staged)

    def abort(self, messages: list[Listed | None]) -> None:
        store, _, staged = self._open()
        try:
            store.delete_dir(staged)
        except OSError:
            pass  # nothing was staged


class BookFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "book_files"

    def schema(self) -> str:
        return "file_name string, payload binary"

    def writer(self, schema: T.StructType, overwrite: bool) -> BookWriter:
        return BookWriter(self.options["path"], self.options.get("run") or uuid.uuid4().hex)


def save_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Write each archive (file_name, payload) into ``folder``; the rows without payloads, with ``saved_path``.

    A failed write is no failure of the book: its ``saved_path`` is null.
    """
    spark = archives.sparkSession
    spark.dataSource.register(BookFiles)
    run = uuid.uuid4().hex
    archives.select("file_name", "payload").write.format("book_files").mode("append").option("path", folder).option("run", run).save()
    return archives.drop("payload").join(saved_files(spark, folder, run), "file_name", "left")


def listed_files(spark: SparkSession, folder: str, glob: str = "*.epub") -> DataFrame:
    """(file_path, length) of the book files of a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return found.select(F.concat(F.lit(folder.rstrip("/") + "/"), F.element_at(F.split("path", "/"), -1)).alias("file_path"), "length")


def remove_files(files: DataFrame) -> DataFrame:
    """Delete files (file_path), each in the task that holds its row; ``removed`` tells whether it is gone.

    A file that is missing already is gone, so a repeated task gives the same rows. Files go when the result is evaluated.
    """

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = []
            for path in batch.column("file_path").to_pylist():
                store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                try:
                    if store.get_file_info(name).type != fs.FileType.NotFound:
                        store.delete_file(name)
                    gone.append(True)
                except OSError:
                    gone.append(False)
            yield pa.RecordBatch.from_arrays([batch.column("file_path"), pa.array(gone, pa.bool_())], ["file_path", "removed"])

    return files.select("file_path").mapInArrow(removed, "file_path string, removed boolean")


def saved_files(spark: SparkSession, folder: str, run: str) -> DataFrame:
    """(file_name, saved_path) of one job; empty if it could not write at all."""
    try:
        return spark.read.schema(SAVED_SCHEMA).json(f"{folder.rstrip('/')}/_saved/{run}").distinct()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], SAVED_SCHEMA)

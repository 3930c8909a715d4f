"""The progress log as numbered appends, followed from any index of any job.

``JobLog.append`` writes events to a folder of their own and commits it under the next number, so a reader sees an
append whole or not at all. The stream source ``job_log`` has commit numbers as offsets; a query's checkpoint thus
keeps its place, and a restarted query goes on behind the last append it has read: history first, then live, without a gap or a repeat.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.commits import CommitLog, StaleSnapshot
from .progress import EVENT_SCHEMA


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


class JobLog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, f"{self.root}/_log")

    def append(self, events: DataFrame) -> int:
        """Write events; gives the number of the append. Of several writers each gets a number of its own."""
        folder = f"data/{uuid.uuid4().hex}"
        events.write.parquet(f"{self.root}/{folder}")
        while True:
            number = self.log.latest()[0] + 1
            try:
                self.log.publish(number, {"folder": folder})
                return number
            except StaleSnapshot:
                continue  # the number went to another append

    def read(self) -> DataFrame:
        folders = [self.log.content(v)["folder"] for v in self.log.versions()]
        if not folders:
            return self.spark.createDataFrame([], EVENT_SCHEMA)
        return self.spark.read.schema(EVENT_SCHEMA).parquet(*[f"{self.root}/{f}" for f in folders])

    def follow(self, after: int = 0, jobs: dict[str, int] | None = None, only: bool = False) -> DataFrame:
        """Events of all jobs behind index ``after``, or behind a job's own index in ``jobs``; with ``only``, of those jobs alone."""
        self.spark.dataSource.register(JobLogSource)
        options = {"path": self.root, "after": str(after), "jobs": json.dumps(jobs or {}), "only": str(only).lower()}
        return self.spark.readStream.format("job_log").options(**options).load()


@dataclass
class AppendedFile(InputPartition):
    path: str


class JobLogReader(DataSourceStreamReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.schema = schema
        self.root = options["path"].rstrip("/")
        self.after = int(options.get("after", 0))
        self.jobs: dict[str, int] = json.loads(options.get("jobs", "{}"))
        self.only = options.get("only", "false") == "true"

    def initialOffset(self) -> dict:
        return {"commit": 0}

    def latestOffset(self) -> dict:
        store, root = _store(self.root)
        found = store.get_file_info(fs.FileSelector(f"{root}/_log", allow_not_found=True))
        numbers = [int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json") and f.base_name[:-5].isdigit()]
        return {"commit": max(numbers, default=0)}

    def partitions(self, start: dict, end: dict) -> Sequence[AppendedFile]:
        store, root = _store(self.root)
        files = []
        for number in range(start["commit"] + 1, end["commit"] + 1):
            with store.open_input_stream(f"{root}/_log/{number:020d}.json") as commit:
                folder = json.loads(commit.read())["folder"]
            found = store.get_file_info(fs.FileSelector(f"{root}/{folder}"))
            files += [AppendedFile(f.path) for f in sorted(found, key=lambda f: f.path) if f.base_name.endswith(".parquet")]
        return files

    def read(self, partition: AppendedFile) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.root)
        target = to_arrow_schema(self.schema)
        with store.open_input_file(partition.path) as data:
            for batch in pq.ParquetFile(data).iter_batches(columns=self.schema.names):
                yield self._behind(batch).select(self.schema.names).cast(target)

    def _behind(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        job, seq = batch.column("job_id"), batch.column("seq")
        if not self.jobs:
            return batch.filter(pc.greater(seq, self.after))
        named = pa.array(list(self.jobs), job.type)
        at = pc.index_in(job, value_set=named)
        start = pa.array(self.jobs.values(), pa.int64()).take(at)
        known = pc.greater(seq, pc.fill_null(start, self.after))
        return batch.filter(pc.and_(known, at.is_valid()) if self.only else known)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class JobLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "job_log"

    def schema(self) -> str:
        return EVENT_SCHEMA

    def streamReader(self, schema: T.StructType) -> JobLogReader:
        return JobLogReader(schema, dict(self.options))

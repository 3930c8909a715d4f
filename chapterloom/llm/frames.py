"""Tables kept in the shared folder, and folds and samples common to the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, shared_dir

#: Rows of whole texts that go to a Python worker at once.
BATCH_ROWS = 2_000


def ready(spark: SparkSession) -> SparkSession:
    """Session settings for operators on whole texts: small batches keep workers and executors small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return prepare(spark)


@contextmanager
def session_settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings for the jobs that run inside; the session's own come back afterwards."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


#: Shuffle files of a job go when it ends, for jobs whose result is a written table: nothing reads them afterwards.
SWEPT = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def shared_path(df: DataFrame, name: str) -> str:
    """A new folder under the one the cluster names in ``spark.checkpoint.dir``."""
    return f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends there."""
    path = shared_path(df, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, also if it holds dots."""
    return df[f"`{name}`"]


def held_out(doc_id: Column) -> Column:
    """The test fold: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded(df: DataFrame, key: Column, limit: int) -> DataFrame:
    """About ``limit`` rows at most, picked by a hash of ``key``; all rows if there are no more.

    The share is set from a count, so the expected size never exceeds ``limit``.
    Which rows are taken depends on the key alone.
    """
    total = df.count()
    if total <= limit:
        return df
    cut = int(limit / total * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) < cut)


def balanced(df: DataFrame, group: str, key: Column, limit: int) -> DataFrame:
    """About ``limit`` rows at most, as many of each value of ``group`` as it has up to one bound; all rows if there are no more.

    The bound follows from counts by value; which rows of a value are taken depends on the key alone.
    """
    sizes = {r[group]: r["count"] for r in df.groupBy(group).count().collect()}
    if sum(sizes.values()) <= limit:
        return df
    left, most = limit, 1.0
    for k, size in enumerate(sorted(sizes.values())):
        most = max(1.0, left / (len(sizes) - k))
        if size > most:
            break
        left -= size
    cuts = {name: int(min(1.0, most / size) * (1 << 30)) for name, size in sizes.items()}
    cut = F.create_map(*(F.lit(x) for pair in cuts.items() for x in pair))[F.col(group)]
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) < cut)

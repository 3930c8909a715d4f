"""Token-id files: ORC with run-length coded integers, row indexes and Bloom filters.

``write_tokens`` deals documents out by ranges of their id, sorts each range and
writes one ORC file for it: (part, local_start, doc_id, n_tokens, ids). ORC keeps
integers run-length coded in stripes, an index entry every ``STRIDE`` rows, and a
Bloom filter on doc_id for each of those, so that readers go stripe by stripe in
parallel and ``find_tokens`` skips what cannot hold an id. Parts are in ascending
order of doc_id, and so are the rows of a part.

Defined results: null text is an empty one (its ids are the end id alone); null
doc_ids come first, in one range; equal doc_ids follow each other in order of
text; an empty table gives a file without rows; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textbytes as B
from .encoding import KNOWN, SLICE, encoder
from .frames import column

#: Rows to an index entry, bytes to a stripe.
STRIDE, STRIPE = 2_000, 16 << 20

FILE_SCHEMA = "part int, local_start long, doc_id {id}, n_tokens long, ids array<int>"


def with_end(ids: np.ndarray, rows: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same rows with one more id at the end of each."""
    out = np.full(len(ids) + len(rows) - 1, end_id, "<u4")
    keep = np.ones(len(out), bool)
    keep[rows[1:] + np.arange(len(rows) - 1)] = False
    out[keep] = ids
    return out, rows + np.arange(len(rows))


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) dealt out by ranges of doc_id, each range in order."""
    narrow = docs.select(
        column(docs, "doc_id").alias("doc_id"), F.coalesce(column(docs, "text").cast("string"), F.lit("")).alias("text")
    )
    return narrow.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, known: int = KNOWN) -> None:
    """Encode every whole text, append ``end_id`` and write the files to ``path``; ``known``: chunks that a worker remembers."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, at = encoder(tokenizer, known), TaskContext.get().partitionId(), 0
        for rows, raw, offsets in B.slices(batches, "text", SLICE):
            ids, first = with_end(*code.encode(raw, offsets)[:2], end_id)
            n = rows.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, part, np.int32)), pa.array(at + first[:-1]), rows.column("doc_id"),
                    pa.array(np.diff(first)), B.list_array(ids.view(np.int32), first, pa.int32()),
                ],
                ["part", "local_start", "doc_id", "n_tokens", "ids"],
            )
            at += int(first[-1])

    ordered = in_order(docs)
    schema = FILE_SCHEMA.format(id=dict(ordered.dtypes)["doc_id"])
    ordered.mapInArrow(encoded, schema).write.format("orc").options(
        **{
            "compression": "zstd", "orc.create.index": "true", "orc.row.index.stride": str(STRIDE),
            "orc.stripe.size": str(STRIPE), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
        }
    ).save(path)


def read_tokens(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files; ``start`` counts the ids of all documents before.

    Only part totals meet in one place, one row a file.
    """
    files = spark.read.schema(FILE_SCHEMA.format(id=id_type)).orc(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")
    )
    return files.join(F.broadcast(before), "part").select(
        "doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids"
    )


def find_tokens(spark: SparkSession, path: str, doc_ids: list, id_type: str = "bigint") -> DataFrame:
    """Rows of some documents; the filter reaches the stripes' indexes and Bloom filters."""
    files = spark.read.schema(FILE_SCHEMA.format(id=id_type)).orc(path)
    return files.where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def digests(tokens: DataFrame) -> DataFrame:
    """``ids`` replaced by the crc32 of the ids as little-endian 32-bit integers."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            at = lists.offsets.to_numpy()
            raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    id_type = dict(tokens.dtypes)["doc_id"]
    return tokens.mapInArrow(summed, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")

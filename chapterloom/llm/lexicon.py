"""Slices of a corpus with word lists of their own, resolved against tables of all words.

A slice is a run of documents of about ``SLICE`` bytes. Its words are found once and
kept as numbers into the slice's list of distinct words. What a table of all words
knows of them comes back as one array a slice (``answered``). So a word is shuffled
once a slice however often it occurs there: no word is a hot key, nothing that grows
with the corpus is broadcast, and texts are cut into words once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as B
from .frames import SWEPT, session_settings, shared_path

#: Bytes of text to a slice; a longer document is a slice of its own.
SLICE = 8 << 20
#: Slices are rows of megabytes: Parquet must look at its buffer after each of them.
_SMALL_GROUPS = {
    "parquet.block.size": str(32 << 20), "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1",
    "compression": "zstd",
}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A word's place in its slice stands above what is known of it.
SHIFT = 32


def merged(batches: Iterator[pa.RecordBatch], name: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of nearly ``limit`` bytes of text or more."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        _, at = B.flat(batch.column(name))
        if held and size + at[-1] > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += int(at[-1])
    if held:
        yield pa.concat_batches(held)


def slices(
    batches: Iterator[pa.RecordBatch], name: str, limit: int = SLICE
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for part in B.slices(merged(batches, name, limit), name, limit):
        yield part
        B.give_back()


def each(batches: Iterator[pa.RecordBatch], rows: int = 1) -> Iterator[pa.RecordBatch]:
    """The same in batches of ``rows``; what they took is given back in between, since rows are megabytes."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)
            B.give_back()


class Words:
    """The words of a slice: where they stand, each row's first (one more at the end), their numbers, the distinct ones."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, members: np.ndarray) -> None:
        self.starts, self.ends, self.first = B.spans(raw, offsets, members)
        edges = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=edges[1:])
        letters = _LOWER[raw[members[raw]]]
        coded = pa.LargeStringArray.from_buffers(len(self.starts), pa.py_buffer(edges), pa.py_buffer(letters)).dictionary_encode()
        self.numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        self.listed = coded.dictionary
        self.row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.listed)


def as_list(values: pa.Array) -> pa.Array:
    """One row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def as_bytes(values: np.ndarray, kind: str = "<i4") -> pa.Array:
    return pa.array([np.ascontiguousarray(values, kind).tobytes()], pa.binary())


def of_bytes(column: pa.Array, row: int, kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(column[row].as_buffer() if column[row].is_valid else b"", kind)


#: Lists are gathered by hash, not by sorting, for so many slices to a task.
_SETTINGS = SWEPT | {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "50000"}


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again; its shuffle files are removed."""
    path = shared_path(df, name)
    with session_settings(df.sparkSession, _SETTINGS):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_slices(df: DataFrame, name: str) -> DataFrame:
    """The same for rows of megabytes."""
    return stored(df, name, **_SMALL_GROUPS)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored, with ``id``: 1, 2, 3 and on without a gap. Only counts by partition meet in one place."""
    kept = stored(df.withColumn("__at", F.monotonically_increasing_id()), name)
    kept = kept.withColumn("__part", F.shiftright("__at", 33))
    sizes = kept.groupBy("__part").count()
    before = sizes.select("__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__before"))
    number = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return kept.join(F.broadcast(before), "__part").select(*df.columns, number.alias("id"))


def looked_up(sliced: DataFrame, known: DataFrame, *beside: str) -> DataFrame:
    """(slice, place, ...): what ``known`` (word, beside, ...) has for each distinct word of each slice.

    The slices' words are not sorted for that: a partition of ``known``, which has each word once or a few times, is hashed.
    """
    asked = sliced.select("slice", *beside, F.posexplode("words").alias("place", "word"))
    return asked.join(known.hint("shuffle_hash"), [*beside, "word"])


def packed(place: Column, known: Column) -> Column:
    """A word's place in its slice and a number of up to 32 bits in one."""
    return F.shiftleft(place.cast("long"), SHIFT).bitwiseOR(known)


def unpacked(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return found >> SHIFT, found & ((1 << SHIFT) - 1)


def answered(sliced: DataFrame, answers: DataFrame, *columns: Column) -> DataFrame:
    """Slices without their word lists, with what was found for them: lists of ``columns`` of ``answers`` (slice, ...).

    The lists are stored first, so that the shuffles that made them are gone before the slices are shuffled.
    """
    found = stored_slices(answers.groupBy("slice").agg(*columns), "answers")
    return sliced.drop("words", "n").join(found, "slice", "left")

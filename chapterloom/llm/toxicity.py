"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on toxic text. The toxic dictionary keeps the
ordinary one as its base and adds the toxic passages behind it; the ordinary dictionary has filler of equal length
there, so ordinary words cost the same under both, and a window is shorter under the toxic one only
where it repeats toxic passages. Toxic passages are the shortest and longest word beginnings that are
over-represented in toxic documents, the ``PASSAGES`` most frequent of them.

Each whole text is cut at blanks into windows of about ``WINDOW`` bytes. The distance of a window is the
difference of its two compressed lengths. A document's features are its largest distance and how many windows
reach each of the calibrated ``LEVELS``; a logistic function of them, fitted on labelled documents, is the score.

Fitting uses at most ``sample`` labelled documents, a third of them toxic (parameter), found and
counted by Spark; the classes are weighted back to their shares among all labels.

Defined results: null and empty texts have no window and get the score of a document without any sign of toxicity;
rows are scored one by one, so repeated rows, nulls and other columns do not matter; labels that are null, or of
documents that do not exist, are not used. Without labels of both kinds all scores are the share of
toxic labels (0 without any label).
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as B
from .frames import bounded, column, stored

SAMPLE = 9_000
WINDOW = 64
#: Bytes of the ordinary base, and number of toxic passages.
BASE, PASSAGES = 16 << 10, 60
EFFORT, MIN_MATCH = 6, 4
#: Bytes by which a window must be shorter; one feature each.
LEVELS = (3, 4, 5, 6, 7, 9)
#: A word beginning is a mark if its rate in toxic documents is at least e**LIFT times that in ordinary ones.
LIFT, MARKS, ORDINARY_WINDOWS = 2.5, 3_000, 6_000

_WORD = re.compile(r"[^\W\d_]+")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def beginnings(word: str) -> list[str]:
    """First 4 to 7 letters of a word, and the whole word with a blank."""
    found = [word[:k] for k in (4, 5, 6, 7) if len(word) >= k]
    return [*found, word + " "] if len(word) >= 4 else found


def windows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the windows of a slice."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    grid = offsets[row] + step * WINDOW
    blanks = np.append(np.flatnonzero(raw <= 0x20), len(raw) + 2 * WINDOW)
    snapped = blanks[np.searchsorted(blanks, grid)]
    starts = np.where((step > 0) & (snapped - grid < WINDOW), snapped, grid)
    starts = np.minimum(starts, offsets[row + 1] - 1)
    keep = np.ones(len(starts), bool)
    keep[1:] = (starts[1:] > starts[:-1]) | (row[1:] != row[:-1])
    starts, row = starts[keep], row[keep]
    ends = np.append(starts[1:], len(raw))
    return starts, np.minimum(ends, offsets[row + 1]), row


class Distance:
    """Compressed lengths under both dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.coders = [self._coder(d) for d in (ordinary, toxic)]

    @staticmethod
    def _coder(content: bytes) -> zstandard.ZstdCompressor:
        form = zstandard.ZstdCompressionParameters.from_level(
            EFFORT, source_size=WINDOW, dict_size=len(content), min_match=MIN_MATCH,
            write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(dict_data=words, compression_params=form)

    def __call__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.int64)
        segments = np.stack([starts, ends - starts], 1).astype(np.uint64)
        held = zstandard.BufferWithSegments(np.ascontiguousarray(_LOWER[raw]).tobytes(), segments.tobytes())
        a, b = (
            np.fromiter((len(x) for x in coder.multi_compress_to_buffer(held, threads=1)), np.int64, len(starts))
            for coder in self.coders
        )
        return a - b


def summary(gain: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """[rows, 2 + 2 * levels]: a one, the largest distance, windows that reach each level, and those by length."""
    out = np.zeros((n, 2 + 2 * len(LEVELS)))
    out[:, 0] = 1
    np.maximum.at(out[:, 1], row, gain)
    size = np.sqrt(1 + np.bincount(row, minlength=n))
    for k, level in enumerate(LEVELS):
        reached = np.bincount(row[gain >= level], minlength=n)
        out[:, 2 + k] = np.log1p(reached)
        out[:, 2 + len(LEVELS) + k] = reached / size
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights by Newton's method with a small ridge."""
    scale = np.maximum(x.std(0), 1e-6)
    scale[0] = 1
    x, w = x / scale, np.zeros(x.shape[1])
    ridge = 0.01 * weight.sum() / len(x) * np.eye(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge @ w
        w = w + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, slope)
    return w / scale


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Model from ``labels`` (doc_id, toxic): the two dictionaries and the weights of the features."""
    marked = labels.select(
        column(labels, "doc_id").alias("doc_id"), (column(labels, "toxic") == 1).alias("toxic")
    ).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    totals = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    n_toxic, n_ordinary = totals.get(True, 0), totals.get(False, 0)
    share = n_toxic / max(1, n_toxic + n_ordinary)
    chosen = bounded(marked.where("toxic"), F.col("doc_id"), sample // 3).union(
        bounded(marked.where("NOT toxic"), F.col("doc_id"), sample - sample // 3)
    )
    texts = docs.select(column(docs, "doc_id").alias("doc_id"), column(docs, "text").cast("string").alias("text"))
    # At most ``sample`` narrow rows are broadcast.
    examples = stored(texts.join(F.broadcast(chosen), "doc_id").where("text IS NOT NULL"), "toxicity-examples")
    sizes = {r.toxic: r["count"] for r in examples.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return {"share": share, "weights": None}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found[toxic].update({g for w in set(_WORD.findall(text.lower())) for g in beginnings(w)})
        for toxic in (False, True):
            held = found[toxic]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(held), pa.string()),
                    pa.array([n if toxic else 0 for n in held.values()], pa.int64()),
                    pa.array([0 if toxic else n for n in held.values()], pa.int64()),
                ],
                ["mark", "toxic", "ordinary"],
            )

    rates = examples.mapInArrow(counted, "mark string, toxic long, ordinary long").groupBy("mark").agg(
        F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")
    )
    lift = F.log((F.col("toxic") + 0.5) / sizes[True]) - F.log((F.col("ordinary") + 0.5) / sizes[False])
    least = max(3, sizes[True] // 100)
    top = rates.where((F.col("toxic") >= least) & (lift >= LIFT)).orderBy(F.desc("toxic"), "mark").limit(MARKS)
    marks = frozenset(r.mark for r in top.collect())

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        parts: list[bytes] = []
        for rows, raw, offsets in B.slices(batches, "text"):
            toxic = rows.column("toxic").to_pylist()
            for text, bad in zip(rows.column("text").to_pylist(), toxic, strict=True):
                if bad:
                    for word in _WORD.findall(text.lower()):
                        found = [g for g in beginnings(word) if g in marks]
                        words.update({g.strip() for g in (*found[:1], *found[-1:])})
            low = _LOWER[raw].tobytes()
            starts, ends, row = windows(raw, offsets)
            parts += [low[a:b] for a, b, r in zip(starts.tolist(), ends.tolist(), row.tolist(), strict=True) if not toxic[r]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([w.encode() for w in words] + parts, pa.binary()),
                pa.array(list(words.values()) + [0] * len(parts), pa.int64()),
            ],
            ["passage", "n"],
        )

    passages = examples.mapInArrow(drawn, "passage binary, n long")
    toxic_words = (
        passages.where("n > 0").groupBy("passage").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "passage").limit(PASSAGES)
    )
    plain = passages.where("n = 0").orderBy(F.xxhash64("passage"), "passage").limit(ORDINARY_WINDOWS)
    ordered = [bytes(r.passage) for r in toxic_words.collect()]
    base = _trained([bytes(r.passage) for r in plain.collect()])
    added = b" ".join([b"", *ordered[::-1], b""])  # the most frequent stand last, where they are nearest
    filler = bytes(random.Random(7).choices(range(128, 256), k=len(added)))
    ordinary, toxic = base + filler, base + added

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(ordinary, toxic)
        for rows, raw, offsets in B.slices(batches, "text"):
            starts, ends, row = windows(raw, offsets)
            x = summary(distance(raw, starts, ends), row, rows.num_rows)
            yield pa.RecordBatch.from_arrays(
                [rows.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))], ["toxic", "x"]
            )

    rows = examples.mapInArrow(measured, "toxic boolean, x array<double>").collect()  # at most ``sample`` short rows
    x, y = np.array([r.x for r in rows]), np.array([r.toxic for r in rows], float)
    weight = np.where(y == 1, share / sizes[True], (1 - share) / sizes[False]) * len(y)
    order = np.lexsort((*x.T, y))
    return {
        "share": share, "ordinary": ordinary, "toxic": toxic,
        "weights": _logistic(x[order], y[order], weight[order]),
    }


def _trained(samples: list[bytes]) -> bytes:
    """Dictionary content trained on the samples; their text itself where there are too few to train on."""
    try:
        return zstandard.train_dictionary(BASE, samples).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-BASE:]


def score(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with score, and the spans (bytes) and distances of the windows that reach the middle level."""
    weights, share = model["weights"], model["share"]
    middle = LEVELS[len(LEVELS) // 2]
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("distance", pa.int32())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = None if weights is None else Distance(model["ordinary"], model["toxic"])
        for rows, raw, offsets in B.slices(batches, "__text"):
            n = rows.num_rows
            value, first, flat = np.full(n, share), np.zeros(n + 1, np.int32), [np.zeros(0, np.int32)] * 3
            if distance is not None:
                starts, ends, row = windows(raw, offsets)
                gain = distance(raw, starts, ends)
                value = 1 / (1 + np.exp(-np.clip(summary(gain, row, n) @ weights, -30, 30)))
                hit = gain >= middle
                flat = [x.astype(np.int32) for x in ((starts - offsets[row])[hit], (ends - offsets[row])[hit], gain[hit])]
                first = np.searchsorted(row[hit], np.arange(n + 1)).astype(np.int32)
            found = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in flat], fields=list(span))
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in keep), pa.array(value), pa.ListArray.from_arrays(pa.array(first), found)],
                [*keep, "score", "spans"],
            )

    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    chosen = docs.select(*[column(docs, c) for c in keep], column(docs, "text").cast("string").alias("__text"))
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return chosen.mapInArrow(
        scored, f"{schema}, score double, spans array<struct<start:int,stop:int,distance:int>>"
    )

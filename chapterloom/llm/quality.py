"""Ordinal cumulative-link regression on graded ratings.

A document of n tokens has the latent quality ``s = sum of weights of its features / sqrt(n)``, and

    P(grade > g) = 1 / (1 + exp(threshold[g] - s)),   threshold[0] <= threshold[1] <= ...

Weights are shared by all grades and live in ``BUCKETS`` hashed buckets. Features: each word folded
to small letters, the run of other characters behind it, its letter case, and whether it repeats the word before. Results are
the expected grade and the tail probability of grades above a level.

Fitting: at most ``sample`` rated documents (parameter). Each round every Spark task refines the current
model on its share by mini-batches with adaptive steps, and the models are averaged; a model has a fixed size.

Defined results: null and empty texts have no features, so their latent quality is 0; rows are scored
one by one, so repeated rows, nulls and other columns do not matter; ratings that are null, or of documents that
do not exist, are not used; a document rated twice counts twice. Without any rating, or with one grade only, every
document has that grade (0 if there is none), and its tail probability is 1 or 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as B
from .frames import bounded, column, stored

SAMPLE = 8_000
BUCKETS = 1 << 18
ROUNDS, EPOCHS, SHARES, BATCH = 4, 2, 6, 128
STEP, SHRINK = 0.3, 1e-6
#: Numbers of a model that are averaged at once.
PIECE = 1 << 15
SCALE = 4.0


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, each row's first feature, and each row's number of words."""
    starts, ends, first = B.spans(raw, offsets, B.ALNUM)
    n = len(starts)
    size = np.diff(first)
    if not n:
        return np.zeros(0, np.int64), first * 4, size
    folded = B.hashes(B.prefix(raw, B.FOLDED), starts, ends)
    row = np.repeat(np.arange(len(size)), size)
    stop = np.minimum(np.append(starts[1:], len(raw)), offsets[row + 1])
    gaps = B.hashes(B.prefix(raw, B.EXACT), ends, stop)
    upper = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw >= 0x41) & (raw <= 0x5A), out=upper[1:])
    capitals = upper[ends] - upper[starts]
    case = np.where(capitals == 0, 0, np.where(capitals == 1, 1, 2)) + 3 * np.minimum(ends - starts, 8)
    same = np.zeros(n, np.uint64)
    same[1:] = (folded[1:] == folded[:-1]) & (row[1:] == row[:-1])
    kinds = np.empty((n, 4), np.uint64)
    kinds[:, 0] = folded
    kinds[:, 1] = B.mixed(gaps + np.uint64(1))
    kinds[:, 2] = B.mixed(case.astype(np.uint64) + np.uint64(2 << 32))
    kinds[:, 3] = B.mixed(same + np.uint64(3 << 32))
    return (kinds.ravel() & np.uint64(BUCKETS - 1)).astype(np.int64), first * 4, size


def latent(weights: np.ndarray, buckets: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(buckets) + 1)
    np.cumsum(weights[buckets], out=sums[1:])
    return (sums[first[1:]] - sums[first[:-1]]) / (SCALE * np.sqrt(np.maximum(size, 1)))


def tails(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade > g) for each row and each threshold."""
    return 1 / (1 + np.exp(np.clip(thresholds[None, :] - score[:, None], -40, 40)))


def refine(weights, memory, thresholds, docs: list[tuple[np.ndarray, int, int]], seed: int) -> None:
    """Mini-batches over (buckets, words, grade) of one share, in place."""
    levels = np.arange(len(thresholds))
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for low in range(0, len(order), BATCH):
            chosen = [docs[i] for i in order[low : low + BATCH]]
            buckets = np.concatenate([d[0] for d in chosen])
            lengths = np.array([len(d[0]) for d in chosen])
            first = np.concatenate([[0], np.cumsum(lengths)])
            size = np.array([d[1] for d in chosen])
            grade = np.array([d[2] for d in chosen])
            upper = tails(latent(weights, buckets, first, size), thresholds)
            # P(grade) is a difference of neighbouring tails; its log gradient needs only those two.
            padded = np.hstack([np.ones((len(chosen), 1)), upper, np.zeros((len(chosen), 1))])
            rows = np.arange(len(chosen))
            high, next_ = padded[rows, grade], padded[rows, grade + 1]
            slope_high, slope_next = high * (1 - high), next_ * (1 - next_)
            chance = np.maximum(high - next_, 1e-9)
            pull = (slope_high - slope_next) / chance
            share = pull / (SCALE * np.sqrt(np.maximum(size, 1)))
            gradient = np.bincount(buckets, np.repeat(share, lengths), len(weights)) / len(chosen) - SHRINK * weights
            memory += gradient**2
            weights += STEP * gradient / np.sqrt(memory + 1e-8)
            push = np.zeros(len(thresholds))
            np.add.at(push, grade[grade > 0] - 1, (-slope_high / chance)[grade > 0])
            inner = grade < len(thresholds)
            np.add.at(push, grade[inner], (slope_next / chance)[inner])
            thresholds += 0.5 * push / len(chosen)
            thresholds[:] = np.maximum.accumulate(thresholds + 1e-6 * levels)


def _trainer(weights, memory, thresholds, seed: int, place: dict[int, int]):
    """Refines a copy of the model on the examples of one share."""
    def trained(part):
        columns = (part.column(c).to_pylist() for c in ("doc_id", "grade", "buckets", "words"))
        held = [(np.frombuffer(b, "<i4"), n, place[g]) for _, g, b, n in sorted(zip(*columns, strict=True))]
        w, m, t = weights.copy(), memory.copy(), thresholds.copy()
        refine(w, m, t, held, seed)
        model = np.concatenate([t, w, m]).astype("<f4")
        pieces = [model[low : low + PIECE].tobytes() for low in range(0, len(model), PIECE)]
        return pa.table({
            "n": pa.array([len(held)] * len(pieces), pa.int64()), "head": pa.array([pieces[0][:256]] * len(pieces), pa.binary()),
            "piece": pa.array(range(len(pieces)), pa.int32()), "model": pa.array(pieces, pa.binary()),
        })

    return trained


def _averaged(part: pa.Table) -> pa.Table:
    """The mean of one piece of the models of all shares."""
    shares = sorted(zip(*(part.column(c).to_pylist() for c in ("n", "head", "model")), strict=True))
    total = sum(n for n, _, _ in shares)
    mean = sum(np.frombuffer(model, "<f4").astype(float) * (n / total) for n, _, model in shares)
    return pa.table({"piece": part.column("piece")[:1].cast(pa.int32()), "mean": pa.array([mean.astype("<f8").tobytes()], pa.binary())})


def fit(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> dict:
    """Model from ``ratings`` (doc_id, grade): ``grades``, ``weights``, ``thresholds``."""
    rated = ratings.select(
        column(ratings, "doc_id").alias("doc_id"), column(ratings, "grade").cast("int").alias("grade")
    ).where("grade IS NOT NULL AND doc_id IS NOT NULL")
    chosen = F.broadcast(bounded(rated, F.col("doc_id"), sample))  # at most ``sample`` narrow rows
    texts = docs.select(column(docs, "doc_id").alias("doc_id"), column(docs, "text").cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offsets in B.slices(batches, "text"):
            buckets, first, size = features(raw, offsets)
            parts = [buckets[a:b].astype("<i4").tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("grade"), pa.array(parts, pa.binary()), pa.array(size)],
                ["doc_id", "grade", "buckets", "words"],
            )

    id_type = dict(texts.dtypes)["doc_id"]
    examples = stored(
        texts.join(chosen, "doc_id").mapInArrow(cut, f"doc_id {id_type}, grade int, buckets binary, words long"),
        "quality-examples",
    )
    grades = sorted(r.grade for r in examples.select("grade").distinct().collect())
    if len(grades) < 2:
        return {"grades": grades or [0], "weights": np.zeros(BUCKETS), "thresholds": np.zeros(0)}
    place = {g: i for i, g in enumerate(grades)}
    weights, memory = np.zeros(BUCKETS), np.zeros(BUCKETS)
    thresholds = np.linspace(-1.0, 1.0, len(grades) - 1)

    for round_ in range(ROUNDS):
        # One model a share, averaged by pieces, so what comes back is one model, of a fixed size.
        shares = examples.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(SHARES))).applyInArrow(
            _trainer(weights, memory, thresholds, round_, place), "n long, head binary, piece int, model binary"
        )
        pieces = shares.groupBy("piece").applyInArrow(_averaged, "piece int, mean binary").toArrow().sort_by("piece")
        mean = np.concatenate([np.frombuffer(x.as_buffer(), "<f8") for x in pieces.column("mean")])
        k = len(thresholds)
        thresholds, weights, memory = mean[:k], mean[k : k + BUCKETS], mean[k + BUCKETS :]
    return {"grades": grades, "weights": weights.astype(np.float32), "thresholds": thresholds}


def grade(docs: DataFrame, model: dict, keep: list[str], above: int) -> DataFrame:
    """Columns ``keep`` with latent, expected_grade and tail: the probability of a grade above ``above``."""
    grades, weights, thresholds = np.array(model["grades"], float), model["weights"], model["thresholds"]
    level = int(np.searchsorted(model["grades"], above, "right")) - 1  # index of the last grade not above

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offsets in B.slices(batches, "__text"):
            score = latent(weights, *features(raw, offsets))
            upper = tails(score, thresholds)
            expected = grades[0] + upper @ np.diff(grades)
            if level < 0:
                tail = np.ones(len(score))
            elif level >= len(thresholds):
                tail = np.zeros(len(score))
            else:
                tail = upper[:, level]
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in keep), pa.array(score), pa.array(expected), pa.array(tail)],
                [*keep, "latent", "expected_grade", "tail"],
            )

    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    chosen = docs.select(*[column(docs, c) for c in keep], column(docs, "text").cast("string").alias("__text"))
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return chosen.mapInArrow(scored, f"{schema}, latent double, expected_grade double, tail double")

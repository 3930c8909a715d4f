"""Benchmark decontamination over a positional inverted index.

Test items are cut into windows of ``WINDOW`` consecutive words (an item of fewer words is one window).
The index holds, for each term of a window and each document that may hold the window, the
positions of the term. A document may hold a window only if it has the window's ``RAREST`` rarest terms,
by their count in the corpus, so no other postings are written.

Matching starts from the rarest term. Each term's positions less its offset in the window are possible starts;
intersecting these lists term by term, rarest first, leaves the starts of exact phrases. With ``slop`` > 0 a
start also stays if every term has a position within ``slop`` words of its place: proximity
matches, reported with their own kind.

Test items are taken in blocks of about ``BLOCK_WORDS`` words, each block against the whole corpus, so
what goes to every task has a fixed bound whatever the benchmark's size.

Defined results: null text has no words and matches nothing; an item without words has no window. Equal
windows of several items count for each of them, and equal items likewise; rows with the same item_id are one item
in counts. A repeated row (doc_id and text equal) gets the same result as its twin; rows of one doc_id with different
texts are judged apart. Null ids are ids like others, though a null item_id is left out of lists and counts.
Empty tables give empty results or documents without hits. Other columns are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as B
from .frames import column, stored

WINDOW, RAREST = 10, 3
BLOCK_WORDS = 500_000
#: The index is dealt out by document: a row holds a document's postings, as a term to its positions.
INDEX = "doc_id {id}, text_key long, n_words long, windows array<int>, postings map<int,array<int>>"


def _blocks(items: DataFrame) -> int:
    words = items.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(1, -(-words // (4 * BLOCK_WORDS)))


class _Block:
    """Terms and windows of one block of items."""

    def __init__(self, rows: list, window: int) -> None:
        raw, offsets = B.flat(pa.array([r.text for r in rows], pa.string()))
        hashes, first = B.word_hashes(raw, offsets, B.ALNUM)
        self.terms, codes = np.unique(hashes, return_inverse=True)
        seen: dict[tuple, int] = {}
        self.items: dict[int, list] = defaultdict(list)
        for i, row in enumerate(rows):
            words = codes[first[i] : first[i + 1]].tolist()
            for low in range(max(1, len(words) - window + 1) if words else 0):
                key = tuple(words[low : low + window])
                self.items[seen.setdefault(key, len(seen))].append(row.item_id)
        self.windows = list(seen)

    def rank(self, counts: np.ndarray, rarest: int) -> None:
        """``plan``: for each window its distinct terms with offsets, rarest first."""
        self.plan = []
        for words in self.windows:
            places: dict[int, list[int]] = defaultdict(list)
            for offset, term in enumerate(words):
                places[term].append(offset)
            order = sorted(places, key=lambda t: (counts[t], t))
            self.plan.append([(t, places[t]) for t in order])
        width = min(rarest, max((len(p) for p in self.plan), default=1))
        self.keys = np.array(
            [([t for t, _ in p] + [p[-1][0]] * width)[:width] if len(p) < width else [t for t, _ in p[:width]] for p in self.plan],
            np.int64,
        ).reshape(len(self.plan), width)
        used = [sorted({t for t, _ in p}) for p in self.plan]
        self.used_at = np.concatenate([[0], np.cumsum([len(u) for u in used])]).astype(np.int64)
        self.used = np.array([t for u in used for t in u], np.int64)


def _codes(terms: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Place of each word among sorted ``terms``, or -1."""
    if not len(terms):
        return np.full(len(words), -1)
    at = np.searchsorted(terms, words)
    at[at == len(terms)] = 0
    return np.where(terms[at] == words, at, -1)


def _text_table(docs: DataFrame) -> DataFrame:
    text = column(docs, "text").cast("string")
    return docs.select(column(docs, "doc_id").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def term_counts(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each of some terms stands in the corpus; one partial sum a task and term."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for _, raw, offsets in B.slices(batches, "text"):
            code = _codes(terms, B.word_hashes(raw, offsets, B.ALNUM)[0])
            total += np.bincount(code[code >= 0], minlength=len(terms))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    rows = docs.select("text").mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(terms), np.int64)
    for row in rows.collect():  # at most one a term of the block
        out[row.term] = row.n
    return out


def build_index(docs: DataFrame, block: _Block) -> DataFrame:
    """One row a document: its words and the postings of windows that it may hold; stored."""
    terms, keys, used, used_at = block.terms, block.keys, block.used, block.used_at
    n_terms = len(terms)
    lead = np.argsort(keys[:, 0], kind="stable") if len(keys) else np.zeros(0, np.int64)
    lead_terms = keys[lead, 0] if len(keys) else lead

    def windows_of(present: np.ndarray) -> np.ndarray:
        """Windows all of whose rarest terms are among the sorted ``present``."""
        low, high = np.searchsorted(lead_terms, present), np.searchsorted(lead_terms, present, "right")
        count = high - low
        if not count.sum():
            return np.zeros(0, np.int64)
        at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        found = lead[at]
        for k in range(1, keys.shape[1]):
            found = found[np.isin(keys[found, k], present)]
        return found

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offsets in B.slices(batches, "text"):
            words, first = B.word_hashes(raw, offsets, B.ALNUM)
            code = _codes(terms, words)
            hit = np.flatnonzero(code >= 0)
            row = np.searchsorted(first, hit, "right") - 1
            order = np.lexsort((hit, code[hit], row))
            hit, row = hit[order], row[order]
            term, place = code[hit], hit - first[row]
            cell = row * n_terms + term
            head = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
            tail = np.append(head[1:], len(cell))[: len(head)]
            cells_row, cells_term = row[head], term[head]
            bounds = np.searchsorted(cells_row, np.arange(rows.num_rows + 1))
            keep, candidates = np.zeros(len(head), bool), []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                found = windows_of(cells_term[a:b])
                candidates.append(found)
                if len(found):
                    wanted = np.unique(np.concatenate([used[used_at[w] : used_at[w + 1]] for w in found.tolist()]))
                    keep[a:b] = np.isin(cells_term[a:b], wanted)
            held = np.flatnonzero(keep)
            sizes = (tail - head)[held]
            starts = np.cumsum(sizes) - sizes
            at = np.repeat(head[held] - starts, sizes) + np.arange(sizes.sum())
            lists = B.list_array(place[at].astype(np.int32), np.append(starts, sizes.sum()), pa.int32())
            edges = np.searchsorted(held, bounds)
            postings = pa.MapArray.from_arrays(
                pa.array(edges.astype(np.int32)), pa.array(cells_term[held].astype(np.int32)), lists
            )
            sizes = np.cumsum([0, *map(len, candidates)])
            windows = B.list_array(np.concatenate([*candidates, np.zeros(0, np.int64)]).astype(np.int32), sizes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("text_key"), pa.array(np.diff(first)), windows, postings],
                ["doc_id", "text_key", "n_words", "windows", "postings"],
            )

    schema = INDEX.format(id=dict(docs.dtypes)["doc_id"])
    return stored(docs.mapInArrow(posted, schema), "positional-index")


def matches(index: DataFrame, block: _Block, slop: int = 0) -> DataFrame:
    """(doc_id, text_key, window, size, starts, kind): intersections inside the index rows, rarest list first."""
    plans = [
        (w, len(block.windows[w]), [(t, o) for t, offsets in plan for o in offsets]) for w, plan in enumerate(block.plan)
    ]
    needs = index.sparkSession.createDataFrame(
        plans, "window int, size int, terms array<struct<term:int,offset:int>>"
    )
    candidates = (
        index.where(F.size("windows") > 0)
        .select("doc_id", "text_key", "postings", F.explode("windows").alias("window"))
        .join(F.broadcast(needs), "window")  # bounded by BLOCK_WORDS
    )

    def starts(need: Column) -> Column:
        held = F.coalesce(F.element_at("postings", need["term"]), F.array().cast("array<int>"))
        return F.transform(held, lambda p: p - need["offset"])

    rest = F.slice("terms", F.lit(2), F.greatest(F.size("terms") - 1, F.lit(0)))
    head = starts(F.element_at("terms", 1))
    listed = candidates.select(
        "doc_id", "text_key", "window", "size",
        F.aggregate(rest, head, lambda acc, need: F.array_intersect(acc, starts(need))).alias("exact"),
        *(
            [
                F.aggregate(
                    rest,
                    head,
                    lambda acc, need: F.filter(
                        acc, lambda s: F.exists(starts(need), lambda p: F.abs(p - s) <= slop)
                    ),
                ).alias("near")
            ]
            if slop
            else []
        ),
    )
    found = listed.select("doc_id", "text_key", "window", "size", F.col("exact").alias("starts"), F.lit("phrase").alias("kind"))
    if slop:
        found = found.unionByName(
            listed.select(
                "doc_id", "text_key", "window", "size", F.array_except("near", "exact").alias("starts"),
                F.lit("proximity").alias("kind"),
            )
        )
    return found.where(F.size("starts") > 0)


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, rarest: int = RAREST, slop: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Per document (doc_id, text_key, n_words, n_hit, item_ids), and all matches with their item_ids.

    ``n_hit`` counts the words inside any exact occurrence of a window.
    """
    spark = docs.sparkSession
    texts = _text_table(docs)
    tests = items.select(column(items, "item_id").alias("item_id"), column(items, "text").cast("string").alias("text"))
    tests = tests.where("text IS NOT NULL")
    blocks = _blocks(tests)
    item_type = dict(tests.dtypes)["item_id"]
    words, found = None, []
    for number in range(blocks):
        rows = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).collect()
        block = _Block(sorted(rows, key=lambda r: (str(r.item_id), r.text)), window)
        block.rank(term_counts(texts, block.terms), rarest)
        index = build_index(texts, block)
        words = index if words is None else words
        members = spark.createDataFrame(
            [(w, i) for w, ids in block.items.items() for i in sorted({x for x in ids if x is not None})],
            f"window int, item_id {item_type}",
        ).groupBy("window").agg(F.collect_set("item_id").alias("item_ids"))
        hits = matches(index, block, slop).join(F.broadcast(members), "window", "left")
        found.append(hits.withColumn("item_ids", F.coalesce("item_ids", F.array().cast(f"array<{item_type}>"))))
    every = stored(reduce(DataFrame.unionByName, found), "window-matches")
    spans = (
        every.where("kind = 'phrase'")
        .groupBy("doc_id", "text_key")
        .agg(
            F.flatten(F.collect_list(F.transform("starts", lambda s: F.struct(s.alias("a"), (s + F.col("size")).alias("b"))))).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"),
        )
        .select(
            F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), "item_ids",
            F.aggregate(
                F.array_sort("spans"),
                F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
                lambda acc, x: F.struct(
                    F.greatest(acc["end"], x["b"]).alias("end"),
                    (acc["n"] + F.greatest(x["b"] - F.greatest(acc["end"], x["a"]), F.lit(0))).alias("n"),
                ),
            )["n"].alias("n_hit"),
        )
    )
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & F.col("text_key").eqNullSafe(F.col("hit_key"))
    result = words.select("doc_id", "text_key", "n_words").join(spans, same, "left").select(
        "doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast(f"array<{item_type}>")).alias("item_ids"),
    )
    return result, every

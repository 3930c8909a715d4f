"""Packing: documents in order, cut into windows by dynamic programming.

Documents stand one after another in order of doc_id. A window holds at most
``window`` ids. Windows end at document ends (free) or sentence ends (a truncation
penalty); where a stretch of over ``STRETCH`` ids has neither, also at word starts
about ``STRETCH / 4`` apart, for a higher penalty. The plan minimises

    padding + truncation penalties + ``WINDOW_COST`` a window.

A window is padded to ``window`` unless its length is a power of two, so the cost
of the window from boundary i to boundary j is ``window - (b[j] - b[i])``; the best i
is the least ``f[i] + b[i]`` among those within reach, which a monotone queue keeps at its
head. Windows whose length is a smaller power of two are looked up one by one.

A range of doc_ids is packed by one task as it streams past: a horizon of ``HORIZON``
windows is planned, all but the last few are settled, and the rest is planned
again with what follows. Memory is bounded by the horizon and the longest document.

Defined results: null or empty text is the end id alone; null doc_ids come first;
equal doc_ids follow in order of text, each row a document of its own; an empty table gives no
pieces; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import textbytes as B
from .encoding import KNOWN, SLICE, encoder, forget
from .tokens import in_order, with_end

WINDOW = 2048
SENTENCE_COST, WORD_COST, WINDOW_COST = 4, 24, 8
STRETCH = 256
HORIZON, KEEP = 192, 8

PIECES = (
    "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
    " padded long"
)
_ENDS = B.byte_class(b".!?")


def best_cuts(at: list[int], cost: list[int], window: int = WINDOW) -> list[int]:
    """Indexes of the boundaries at which windows end.

    ``at``: ascending positions, the first is where the first window begins, no two further
    apart than ``window``; ``cost``: the penalty of a cut at each.
    """
    # Boundaries that are a smaller power of two apart, found beforehand: they are few.
    place, near = np.asarray(at), {}
    for length in (1 << k for k in range(7, window.bit_length()) if 1 << k < window):
        back = np.searchsorted(place, place - length)
        hit = np.flatnonzero(place[back] == place - length)
        for j, i in zip(hit.tolist(), back[hit].tolist(), strict=True):
            near.setdefault(j, []).append(i)
    total, lead, came = [0] * len(at), [0] * len(at), [0] * len(at)
    lead[0] = at[0]
    queue: deque[int] = deque([0])
    for j in range(1, len(at)):
        here = at[j]
        while at[queue[0]] < here - window:
            queue.popleft()
        i = queue[0]
        best = lead[i] + window - here
        for k in near.get(j, ()):
            if total[k] < best:
                best, i = total[k], k
        best += cost[j] + WINDOW_COST
        total[j], came[j] = best, i
        lead[j] = key = best + here
        while queue and lead[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(at) - 1
    while j > 0:
        cuts.append(j)
        j = came[j]
    return cuts[::-1]


def boundaries(raw, starts, first, rows) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a slice's ids where a window may end, and the penalty of each."""
    ends = rows[1:]
    inner = starts > 0
    before = raw[np.maximum(starts - 1, 0)]
    blank = (raw[starts] == 0x20) | (raw[starts] == 0x0A) if len(starts) else np.zeros(0, bool)
    sentence = first[inner & blank & _ENDS[before]] if len(starts) else first
    at = np.union1d(sentence, ends)
    edges = np.concatenate([[0], at])
    wide = np.flatnonzero(np.diff(edges) > STRETCH)
    extra = []
    for k in wide.tolist():
        low, high = int(edges[k]), int(edges[k + 1])
        marks = np.arange(low + STRETCH // 4, high, STRETCH // 4)
        near = np.searchsorted(first, marks)
        word = first[np.minimum(near, len(first) - 1)] if len(first) else marks
        word = np.where((word > low) & (word < high) & (word - marks < STRETCH // 4), word, marks)
        extra.append(word)
    # Cheaper kinds come first, and the first of equal positions counts.
    kinds = [(ends, 0), (sentence, SENTENCE_COST), *((x, WORD_COST) for x in extra)]
    every = np.concatenate([x for x, _ in kinds])
    cost = np.repeat([c for _, c in kinds], [len(x) for x, _ in kinds])
    order = np.argsort(every, kind="stable")
    every, cost = every[order], cost[order]
    keep = every > 0
    keep[1:] &= every[1:] != every[:-1]
    return every[keep], cost[keep]


class _Packer:
    """Streams documents of one range; gives settled pieces."""

    def __init__(self, part: int, window: int) -> None:
        self.window, self.part, self.sequence = window, part, 0
        self.docs: deque[tuple[int, int, np.ndarray]] = deque()  # row number, first position, ids
        self.ids: deque = deque()
        self.at: list[int] = [0]
        self.cost: list[int] = [0]
        self.position = 0

    def add(self, doc_ids: list, ids: np.ndarray, rows: np.ndarray, at: np.ndarray, cost: np.ndarray) -> None:
        for doc_id, a, b in zip(doc_ids, rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            self.docs.append((doc_id, self.position + a, ids[a:b]))
        self.at += (at + self.position).tolist()
        self.cost += cost.tolist()
        self.position += int(rows[-1])

    def settle(self, last: bool) -> list[tuple]:
        if len(self.at) < 2 or not last and self.at[-1] - self.at[0] < HORIZON * self.window:
            return []
        cuts = best_cuts(self.at, self.cost, self.window)
        if not last:
            cuts = cuts[:-KEEP]
        out, low = [], self.at[0]
        for j in cuts:
            high = self.at[j]
            self._pieces(low, high, out)
            low = high
            self.sequence += 1
        done = cuts[-1]
        self.at, self.cost = self.at[done:], self.cost[done:]
        return out

    def _pieces(self, low: int, high: int, out: list) -> None:
        size, offset = high - low, 0
        padded = size if size & (size - 1) == 0 else self.window
        number = (self.part << 40) + self.sequence
        while low < high:
            doc_id, begin, ids = self.docs[0]
            end = begin + len(ids)
            stop = min(high, end)
            piece = ids[low - begin : stop - begin]
            out.append((doc_id, low - begin, stop - low, zlib.crc32(piece), len(ids), number, offset, padded))
            offset += stop - low
            low = stop
            if stop == end:
                self.docs.popleft()


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, known: int = KNOWN, last: bool = False
) -> DataFrame:
    """Pieces of all documents, see ``PIECES``; every id lies in exactly one.

    ``known``: chunks that a worker remembers; with ``last`` it drops them after each task, for the sake of what else it runs.
    """
    ordered = in_order(docs)
    id_type = dict(ordered.dtypes)["doc_id"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, packer = encoder(tokenizer, known), _Packer(TaskContext.get().partitionId(), window)
        kind = None
        for rows, raw, offsets in B.slices(batches, "text", SLICE):
            kind = rows.schema.field("doc_id").type
            ids, first, starts, chunk_first = code.encode(raw, offsets)
            row = np.searchsorted(offsets, starts, "right") - 1
            ids, first = with_end(ids, first, end_id)
            at, cost = boundaries(raw, starts, chunk_first + row, first)
            packer.add(rows.column("doc_id").to_pylist(), ids, first, at, cost)
            yield from _batch(packer.settle(False), kind)
        yield from _batch(packer.settle(True), kind)
        if last:
            del code
            forget()
            B.give_back()

    return ordered.mapInArrow(packed, PIECES.format(id=id_type))


def _batch(pieces: list[tuple], kind) -> Iterator[pa.RecordBatch]:
    if pieces:
        first, *rest = zip(*pieces, strict=True)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded"]
        yield pa.RecordBatch.from_arrays([pa.array(first, kind), *(pa.array(x, pa.int64()) for x in rest)], names)

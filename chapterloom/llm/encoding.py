"""Whole texts to token ids with a public tokenizer, each distinct chunk encoded once.

Both tokenizers used here split a text before they merge, so a text may be cut
wherever that split always falls, and each part encoded on its own:

* before a space or line feed between two visible characters (a line feed is also cut off behind),
* between an ASCII letter and ASCII punctuation other than the apostrophe.

A code point that could be Unicode white space is never a neighbour of a cut, and
a row that may hold a special token (``<|``) is one chunk. The chunks tile the
batch, Arrow finds the distinct ones, and the tokenizers library encodes those.
"""

from __future__ import annotations

import os
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import textbytes as B

#: Distinct chunks that a worker remembers.
KNOWN = 600_000
#: Bytes of text to encode at once: the larger, the fewer distinct chunks are looked up.
SLICE = 4 << 20

_SOLID = B.byte_class(range(0x21, 0x7F))
#: First bytes of code points none of which is white space.
_LEAD = B.byte_class([*range(0xC3, 0xE1), *range(0xE4, 0x100)])
_ASCII_LETTER = B.byte_class([*range(0x41, 0x5B), *range(0x61, 0x7B)])
_PUNCT = B.byte_class([b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27])


def chunk_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which chunks begin; the first bytes of rows are among them."""
    n = len(raw)
    cut = np.zeros(n + 2, bool)
    if n > 2:
        right = _SOLID[raw]
        left = right.copy()
        lead = np.flatnonzero(raw >= 0xC0)
        kind = raw[lead]
        sure = _LEAD[kind]
        lead, kind = lead[sure], kind[sure]
        right[lead] = True
        left[np.minimum(lead + 1 + (kind >= 0xE0) + (kind >= 0xF0), n - 1)] = True  # a code point's last byte
        middle = np.zeros(n, bool)
        middle[1:-1] = left[:-2] & right[2:]
        cut[:n] |= middle & ((raw == 0x20) | (raw == 0x0A))
        cut[1 : n + 1] |= middle & (raw == 0x0A)
        cut[1:n] |= _PUNCT[raw[1:]] & _ASCII_LETTER[raw[:-1]]
        special = np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C))
        for row in np.unique(np.searchsorted(offsets, special, "right") - 1):
            cut[offsets[row] : offsets[row + 1]] = False
    rows = offsets[:-1][offsets[1:] > offsets[:-1]]
    cut[rows] = True
    return np.flatnonzero(cut[:n])


#: White space, apart from a blank in front, and the joint's own sign: chunks that hold any of it are encoded on their own.
_JOINABLE = r"^ ?[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}%s]+$"
#: Texts that may part two chunks: the first one to which this tokenizer gives an id of its own is taken.
_JOINTS = ("\n", " \u00b6 ", " ~ ", " \u00a7 ", " ` ")
#: Chunks that are encoded as one text.
_JOINED = 100


class _Store:
    """Chunks and their ids: ``known`` has a chunk's place in ``base`` and ``size``, which point into ``pool``."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, np.int32)
        self.base = np.zeros(1 << 14, np.int32)
        self.size = np.zeros(1 << 14, np.int32)
        self.used = 0

    def add(self, chunks: list[str], flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Places of new chunks with these ids."""
        at = len(self.known)
        self.pool = _room(self.pool, self.used + len(flat))
        self.base, self.size = _room(self.base, at + len(chunks)), _room(self.size, at + len(chunks))
        self.pool[self.used : self.used + len(flat)] = flat
        self.size[at : at + len(chunks)] = sizes
        self.base[at : at + len(chunks)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.known.update(zip(chunks, range(at, at + len(chunks)), strict=True))
        return np.arange(at, at + len(chunks))

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some chunks one after another, and their numbers."""
        sizes = self.size[places]
        first = np.cumsum(sizes) - sizes
        return self.pool[np.repeat(self.base[places] - first, sizes) + np.arange(int(sizes.sum()))], sizes


class Encoder:
    """Token ids of batches of texts, as the tokenizer gives them for each whole text.

    Up to ``known`` chunks are remembered, in two halves: what is met while the younger half fills up goes there, and the
    older half, which holds what was not met since, is then forgotten.
    """

    def __init__(self, path: str, known: int = KNOWN) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)  # no chunk comes twice
        self.limit = max(1, known // 2)
        self.young, self.old = _Store(), _Store()
        self.joint = self._find_joint()

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _find_joint(self) -> tuple[str, int] | None:
        for joint in _JOINTS:
            ids = self._plain(joint)
            if len(ids) == 1 and all(
                self._plain(joint.join(pair)) == self._plain(pair[0]) + ids + self._plain(pair[1])
                for pair in (("a", "b"), ("a", " b"), (" a.", "9"), ("'s", "'t"), ("-", " -"), ("é", " é"))
            ):
                return joint, ids[0]
        return None

    def _encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks one after another, and their numbers."""
        encoded = [x.ids for x in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        sizes = np.fromiter(map(len, encoded), np.int32, len(encoded))
        return np.fromiter(chain.from_iterable(encoded), np.int32, int(sizes.sum())), sizes

    def _joined(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same by way of texts of many chunks with joints between them: far fewer calls and objects."""
        joint, mark = self.joint
        groups = [chunks[i : i + _JOINED] for i in range(0, len(chunks), _JOINED)]
        flat, sizes = [], []
        for group, got in zip(groups, self.tokenizer.encode_batch_fast(list(map(joint.join, groups)), add_special_tokens=False), strict=True):
            ids = np.array(got.ids, np.int32)
            cuts = np.flatnonzero(ids == mark)
            if len(cuts) != len(group) - 1:  # a chunk has the joint's id in it
                ids, size = self._encoded(group)
            else:
                size = np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
                ids = np.delete(ids, cuts)
            flat.append(ids)
            sizes.append(size)
        return np.concatenate(flat), np.concatenate(sizes).astype(np.int32)

    def _learn(self, chunks: pa.Array, listed: np.ndarray) -> np.ndarray:
        """Places of chunks not met before, in their order."""
        places = np.empty(len(listed), np.int64)
        joinable = np.zeros(len(listed), bool)
        if self.joint:
            joinable = pc.match_substring_regex(chunks, _JOINABLE % self.joint[0].strip()).to_numpy(zero_copy_only=False)
        for own, encode in ((np.flatnonzero(joinable), self._joined), (np.flatnonzero(~joinable), self._encoded)):
            if len(own):
                names = listed[own].tolist()
                places[own] = self.young.add(names, *encode(names))
        return places

    def _places(self, chunks: pa.Array) -> np.ndarray:
        """Places in the younger half of distinct chunks; those in neither half are encoded."""
        if len(self.young.known) >= self.limit:
            self.old, self.young = self.young, _Store()
        listed = chunks.to_numpy(zero_copy_only=False)
        places = np.fromiter(map(self.young.known.get, listed, repeat(-1)), np.int64, len(listed))
        missing = np.flatnonzero(places < 0)
        if len(missing) and self.old.known:
            names = listed[missing]
            before = np.fromiter(map(self.old.known.get, names, repeat(-1)), np.int64, len(names))
            met = before >= 0
            if met.any():
                places[missing[met]] = self.young.add(names[met].tolist(), *self.old.ids(before[met]))
            missing = missing[~met]
        if len(missing):
            places[missing] = self._learn(chunks.take(pa.array(missing)), listed[missing])
        return places

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, each row's first id (one more at the end), chunk starts in bytes and in ids."""
        starts = chunk_starts(raw, offsets)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64), starts, np.zeros(0, np.int64)
        edges = np.append(starts, len(raw)).astype(np.int32)
        chunks = pa.StringArray.from_buffers(
            len(starts), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(raw))
        ).dictionary_encode()
        codes = self._places(chunks.dictionary)[chunks.indices.to_numpy(zero_copy_only=False)]
        counts = self.young.size[codes]
        ends = np.cumsum(counts, dtype=np.int32)
        first = ends - counts
        at = np.repeat(self.young.base[codes] - first, counts)
        at += np.arange(len(at), dtype=np.int32)
        ids = self.young.pool[at].view("<u4")
        first = first.astype(np.int64)
        rows = np.append(first, len(ids))[np.searchsorted(starts, offsets)]
        return ids, rows, starts, first


def _room(values: np.ndarray, need: int) -> np.ndarray:
    if need <= len(values):
        return values
    return np.concatenate([values, np.zeros(max(need, 2 * len(values)) - len(values), values.dtype)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str, known: int = KNOWN) -> Encoder:
    """One per worker process, with what it has learned so far."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, known)
    return _encoders[path]


def forget() -> None:
    """Drop what this process has learned, for tasks after which other work follows."""
    _encoders.clear()

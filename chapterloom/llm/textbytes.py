"""Words of a batch of texts as flat arrays: no Python object per word.

A batch is one run of UTF-8 bytes with row offsets. Words are found by a table of
256 byte classes; each gets a 64-bit hash from prefix sums, so that a pass costs
a few nanoseconds a byte. Slices hold ``SLICE`` bytes of text or a single row.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer row is a slice of its own.
SLICE = 1 << 20

_seed = np.random.default_rng(20240917)
_ODD = int(_seed.integers(1 << 62, dtype=np.uint64)) * 2 + 1
#: One random number for each byte value; capital ASCII letters share those of the small ones.
_BYTE = _seed.integers(1 << 63, size=256, dtype=np.uint64)
FOLDED = _BYTE.copy()
FOLDED[65:91] = _BYTE[97:123]
EXACT = _BYTE
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def byte_class(chosen) -> np.ndarray:
    """A table of 256 flags."""
    table = np.zeros(256, bool)
    table[list(chosen)] = True
    return table


#: Digits, ASCII letters and every byte of a code point above 0x7F.
ALNUM = byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
LETTER = byte_class([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: All but the six ASCII white-space characters.
VISIBLE = ~byte_class([0x20, *range(0x09, 0x0E)])


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array; null rows are empty."""
    if pa.types.is_large_string(texts.type):
        width = np.int64
    else:
        texts, width = texts.cast(pa.string()), np.int32
    _, offsets, data = texts.buffers()
    if offsets is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(
    batches: Iterator[pa.RecordBatch], name: str, limit: int = SLICE
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of each batch with the bytes and offsets of one text column.

    At the end a worker gives back what it has freed, since it stays for other tasks.
    """
    try:
        for batch in batches:
            _, at = flat(batch.column(name))
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
                part = batch.slice(low, high - low)
                raw, offsets = flat(part.column(name))
                yield part, raw, offsets
                low = high
    finally:
        give_back()


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _tables(length: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) <= length:
        size = max(length + 1, SLICE + 1)
        with np.errstate(over="ignore"):
            steps = np.full(size, _ODD, np.uint64)
            steps[0] = 1
            _powers = np.cumprod(steps, dtype=np.uint64)
            steps[1:] = pow(_ODD, -1, 1 << 64)
            _inverse = np.cumprod(steps, dtype=np.uint64)
    return _powers, _inverse


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(raw: np.ndarray, offsets: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of member bytes within rows, and each row's first run."""
    inside = members[raw]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        before[offsets[:-1][offsets[:-1] < len(raw)]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix(raw: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any run of bytes follows."""
    powers, _ = _tables(len(raw))
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values[raw] * powers[: len(raw)], out=sums[1:])
    return sums


def hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of bytes."""
    _, inverse = _tables(len(sums))
    value = (sums[ends] - sums[starts]) * inverse[starts]
    return mixed(value + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(raw, offsets, members, values=FOLDED):
    """Hash of every word, and the first word of each row (one more at the end)."""
    starts, ends, first = spans(raw, offsets, members)
    return hashes(prefix(raw, values), starts, ends), first


def list_array(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Flat values as one list a row."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32), pa.int32()), pa.array(values, kind))

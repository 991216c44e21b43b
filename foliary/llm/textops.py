"""Vectorised text helpers that run inside Arrow tasks: bytes, words, word hashes and shingles of a batch.

A batch is one Arrow string column; its texts lie end to end in one UTF-8 buffer, so words of all its
documents are found and hashed with a few NumPy passes instead of a Python loop per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Word separators of the contracts: space and U+0009 to U+000D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240601))
_ORDER = _rng.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROOT = 0x9E3779B97F4A7C15
_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its texts. Null counts as empty; lower: A-Z only."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return LOWER[data] if lower else data, offsets - offsets[0]


class Rolling:
    """Hashes of any substring of at most ``most`` bytes, or 64-bit hashes of words, from one pass of prefix sums modulo 2 ** 64."""

    def __init__(self, most: int):
        self.up, self.down = np.ones(most + 1, np.uint64), np.ones(most + 1, np.uint64)
        self.up[1:], self.down[1:] = _ROOT, pow(_ROOT, -1, 1 << 64)
        self.up, self.down = np.cumprod(self.up, dtype=np.uint64), np.cumprod(self.down, dtype=np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_TABLE[data] if data.dtype == np.uint8 else data) * self.up[: len(data)], out=out[1:])
        return out

    def grams(self, prefix: np.ndarray, size: int) -> np.ndarray:
        return mix((prefix[size:] - prefix[:-size]) * self.down[: len(prefix) - size])

    def spans(self, prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((prefix[b] - prefix[a]) * self.down[a])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n + 1 word offsets of the documents."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty span, eight bytes at a time; the few spans over 256 bytes by BLAKE2."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each position
    left = (ends - starts).astype(np.int64)
    out = mix(left.astype(np.uint64) * _ORDER[7])
    long = np.flatnonzero(left > _LONG)
    at = starts.astype(np.int64)
    block = blocks[at] & _MASKS[np.minimum(left, 8)]
    out = mix((out ^ block) * _ORDER[0])
    live = np.flatnonzero((left > 8) & (left <= _LONG))
    at, left = at[live] + 8, left[live] - 8
    while len(live):
        block = blocks[at] & _MASKS[np.minimum(left, 8)]
        out[live] = mix((out[live] ^ block) * _ORDER[0])
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in long:
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column in order, and the word offsets of its documents."""
    data, offsets = utf8(column, lower)
    starts, ends, words = word_spans(data, offsets)
    return span_hashes(data, starts, ends), words


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document; fewer than ``size`` words make one shingle, none make none."""
    hashes, words = word_hashes(column)
    n = max(0, len(hashes) - size + 1)
    grams = np.zeros(n, np.uint64)
    for k in range(size):
        grams += hashes[k : k + n] * _ORDER[k]
    grams = mix(grams)
    for a, b in zip(words[:-1], words[1:], strict=True):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        elif b > a:
            short = (hashes[a:b] * _ORDER[: b - a]).sum(keepdims=True, dtype=np.uint64)
            yield mix(short + np.full(1, b - a, np.uint64) * _ORDER[6])
        else:
            yield np.zeros(0, np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def batches(source: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text (one row at least), so memory doesn't follow Spark's batch."""
    for batch in source:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
            yield batch.slice(a, b - a)
            a = b
    # A worker outlives its tasks: what Arrow's pool holds but no longer uses goes back.
    pa.default_memory_pool().release_unused()

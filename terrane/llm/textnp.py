"""Vectorized words and shingles over Arrow text columns (NumPy, no Python object a word).

Hashes are 64-bit: a polynomial over random byte values, then a bijective mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
_STEP = _rng.integers(1, 1 << 63, dtype=U64) * U64(2) + U64(1)
_PLACE = _rng.integers(1, 1 << 63, 8, dtype=U64) * U64(2) + U64(1)
_LOWERED = _BYTE.copy()
_LOWERED[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.ones(1, U64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x9E3779B97F4A7C15)
    h = h ^ (h >> U64(29))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def powers(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        size = max(n, 2 * len(_powers), 64)
        _powers = np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, _STEP, U64), dtype=U64)])
    return _powers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def blocks(batch: pa.RecordBatch, text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with up to ``limit`` bytes of text, one row at least."""
    _, off = utf8(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each document); words never cross documents."""
    n = len(data)
    word = ~_SPACE[data]
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    edge = off[1:-1]
    before[edge[edge < n]] = False
    after[edge[edge > 0] - 1] = False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return start, end, np.searchsorted(start, off)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """Hash of each byte span."""
    if not len(start):
        return np.zeros(0, U64)
    length = end - start
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    value = (_LOWERED if lower else _BYTE)[data[place + np.repeat(start, length)]] * powers(int(length.max()))[place]
    return mix(np.add.reduceat(value, first) + length.astype(U64) * _PLACE[7])


def window_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hash of each run of ``width`` words, over the whole array; the caller drops those across documents."""
    if len(words) < width:
        return np.zeros(0, U64)
    n = len(words) - width + 1
    total = np.full(n, U64(width), U64)
    for k in range(width):
        total += words[k : k + n] * _PLACE[k]
    return mix(total)


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each document, ASCII case folded.

    A document with fewer than ``width`` words has its whole sequence as its one shingle;
    one without words has none.
    """
    start, end, first = word_spans(data, off)
    words = span_hashes(data, start, end, True)
    windows = window_hashes(words, width)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(windows[a : b - width + 1])
        elif b > a:
            yield window_hashes(words[a:b], b - a)
        else:
            yield np.zeros(0, U64)

"""Words and their 64-bit hashes from Arrow string columns, without a Python object per word.

A word is a run of bytes other than space and 0x09 to 0x0D, with A-Z lower-cased;
as these bytes occur in UTF-8 only as themselves, bytes and characters split alike.
The hash is a polynomial over random byte values modulo 2^64, read off prefix
sums, then mixed with the word's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
CHUNK_BYTES = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = mix(_LOWER.astype(_U) + _U(0x1234567))  # of a byte, after lower-casing
_EXACT = mix(np.arange(256, dtype=_U) + _U(0x1234567))
_WORD_BYTE = np.ones(256, dtype=bool)
_WORD_BYTE[[9, 10, 11, 12, 13, 32]] = False
_powers: list[np.ndarray] = [np.ones(0, _U), np.ones(0, _U)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 65_536)
        for at, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[at] = np.multiply.accumulate(steps)
    return _powers


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string column; null reads as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets.astype(np.int64), np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hashes of the byte spans ``start`` to ``end``, in time linear in the data."""
    n = len(data)
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum((_VALUE if lower else _EXACT)[data] * power[:n], out=sums[1:])
    raw = (sums[end] - sums[start]) * inverse[start]
    return mix(raw + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def _hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts that ``offsets`` (from 0) cut ``data`` into, and where each text's begin."""
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = _WORD_BYTE[data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[1:-1][first]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[last] = inside[1:-1][last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return span_hashes(data, start, end, lower=True), np.searchsorted(start, offsets)


def text_runs(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows of about ``most`` bytes of text, or one row if that is longer."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        stop = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        stop = min(rows, max(first + 1, stop))
        yield first, stop
        first = stop


def hashed_texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per run of rows ``first`` to ``stop`` the hashes of their words and each row's bounds in them.

    A run has about ``CHUNK_BYTES`` of text, or one row if that is longer.
    """
    offsets, data = text_buffers(column)
    for first, stop in text_runs(offsets):
        cut = offsets[first : stop + 1]
        yield first, stop, *_hash_words(data[cut[0] : cut[-1]], cut - cut[0])


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of a text's ``size``-word shingles, sorted; of a shorter text, one for all its words."""
    if not len(words):
        return words
    width = min(size, len(words))
    total = np.full(len(words) - width + 1, width, _U)
    for at in range(width):
        total = mix(total * _U(0x9FB21C651E98DF25) + words[at : at + len(total)])
    return np.unique(total)

"""Vectorised word handling over Arrow batches.

A word is a maximal run of bytes other than space and the controls 9 to 13.
These delimiters are single bytes in UTF-8, so everything works on the bytes of
the column and whole texts are handled whatever their length.  Only A-Z are
lower-cased.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(0x5EED).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_CODES = _BYTE_CODES[LOWER]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


#: Numbers that are worked on at once, so that they stay in the cache.
BLOCK = 1 << 14


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    if x.size <= BLOCK:
        return _mixed(x)
    flat_ = np.ascontiguousarray(x).reshape(-1)
    out = np.empty_like(flat_)
    for i in range(0, len(flat_), BLOCK):
        out[i : i + BLOCK] = _mixed(flat_[i : i + BLOCK])
    return out.reshape(x.shape)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, at, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of at most ``most`` bytes, or of one row."""
    data, offsets = flat(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the index of its first word (n + 1 values)."""
    inside = ~SPACE[data]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[edges] = inside[edges]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    closes[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the given spans of bytes."""
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER_CODES if lower else _BYTE_CODES)[data] * up[: len(data)], dtype=np.uint64, out=total[1:])
    out = (total[ends] - total[starts]) * down[starts]
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_STEP = [np.uint64(x | 1) for x in np.random.default_rng(0x51E9).integers(1, 1 << 63, 64, dtype=np.uint64)]


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's shingles of ``size`` words, in order, with offsets per row.

    A row of fewer words has its whole sequence as one shingle; a row without words has none.
    """
    starts, ends, rows = word_spans(data, offsets)
    h = span_hashes(data, starts, ends)
    n_words = np.diff(rows)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    n = np.where(n_words >= size, n_words - size + 1, (n_words > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(rows[:-1] - at[:-1], n) + np.arange(at[-1])  # the word that each shingle starts at
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    out = np.zeros(len(first), np.uint64)
    for j in range(size):
        out += padded[first + j] * _STEP[j]
    for r in short:
        own = h[rows[r] : rows[r + 1]]
        out[at[r]] = np.sum(own * np.array(_STEP[: len(own)]), dtype=np.uint64) + np.uint64(len(own))
    return mix(out), at


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    own = np.sort(values)
    return own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) > 1 else own


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes."""
    h, at = shingles(data, offsets, size)
    return [distinct(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]

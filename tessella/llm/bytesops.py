"""Vectorised text kernels on Arrow buffers: words, 64-bit word hashes and word shingles without a Python loop per word.

A hash is a polynomial over randomly mapped bytes modulo 2**64 (odd base, so powers can be undone),
then mixed; two given different strings agree with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        made = []
        for base in (_BASE, _INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _powers = (made[0], made[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about most bytes, so that temporaries stay small; a longer row is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and each row's first word (one more than rows)."""
    n = len(raw)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~_SPACE[raw]
    begin = inside[1:] & ~inside[:-1]
    end = inside[:-1] & ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    joined = cut[inside[cut] & inside[cut + 1]]  # two rows' words touch
    begin[joined] = True
    end[joined] = True
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end), np.searchsorted(starts, off)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    pw, inv = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * pw[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def word_hashes(raw: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word and each row's first word."""
    starts, ends, first = word_spans(raw, off)
    return span_hashes(_LOWER[raw] if lower else raw, starts, ends), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of size words; a row with fewer words has one shingle, all its words; a row without words none."""
    n = np.diff(first)
    many = np.maximum(n - size + 1, 0)
    short = (n > 0) & (n < size)
    counts = np.where(short, 1, many)
    out_first = np.concatenate([[0], np.cumsum(counts)])
    if len(words) >= size:
        h = words[: len(words) - size + 1].copy()
        for k in range(1, size):
            h *= _BASE
            h += words[k : len(words) - size + 1 + k]
        h = mix(h)
    else:
        h = np.zeros(0, np.uint64)
    at = np.repeat(first[:-1] - out_first[:-1], counts) + np.arange(out_first[-1])
    out = np.zeros(out_first[-1], np.uint64)
    full = np.repeat(~short, counts)
    out[full] = h[at[full]]
    for r in np.flatnonzero(short):
        x = U(n[r])
        for w in words[first[r] : first[r + 1]]:
            x = x * _BASE + w
        out[out_first[r]] = mix(np.array([x ^ U(0xA5A5A5A5)], np.uint64))[0]
    return out, out_first


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row, in order."""
    raw, off = buffers(column)
    with np.errstate(over="ignore"):
        for i, j in pieces(off):
            words, first = word_hashes(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            h, at = shingle_hashes(words, first, size)
            for r in range(j - i):
                yield i + r, np.unique(h[at[r] : at[r + 1]])

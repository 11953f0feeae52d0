"""Vectorised text kernels: words, lines and their 64-bit hashes over the byte buffers of Arrow string columns.

Hashes are polynomial in the bytes, modulo 2**64, finished with a mixer. Kernels take blocks of rows of about BLOCK bytes;
a longer text is a block of its own. Memory follows the longest text: a byte's flags, and some 40 bytes for each of its
words, about 10 times its length in all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_U30, _U27, _U31 = np.uint64(30), np.uint64(27), np.uint64(31)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_SPACE = ~SPACE
#: Digits, letters and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
NOT_NEWLINE = np.ones(256, bool)
NOT_NEWLINE[10] = False

_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, BLOCK + 1)
        _pow = np.full(size, _P, np.uint64)
        _inv = np.full(size, pow(_P, -1, 1 << 64), np.uint64)
        _pow[0] = _inv[0] = 1
        _pow, _inv = np.cumprod(_pow), np.cumprod(_inv)
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U30)) * _M1
    x = (x ^ (x >> _U27)) * _M2
    return x ^ (x >> _U31)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def blocks(offs: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes, or of one row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of the maximal runs of bytes for which the table `inside` holds; none crosses rows."""
    w = inside[data]
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(w)
    before[0], before[1:] = False, w[:-1]
    full = offs[1:] > offs[:-1]
    before[offs[:-1][full]] = False
    starts = np.flatnonzero(w & ~before)
    before[:-1], before[-1] = w[1:], False
    before[offs[1:][full] - 1] = False
    ends = np.flatnonzero(w & ~before) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each run of bytes, with A-Z lower-cased if asked for."""
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right"))))
        a, b = int(starts[i]), int(ends[j - 1])
        seg = data[a:b]
        power, inverse = _powers(b - a + 1)
        acc = np.empty(b - a + 1, np.uint64)
        acc[0] = 0
        np.cumsum(((LOWER[seg] if lower else seg).astype(np.uint64) + np.uint64(1)) * power[: b - a], out=acc[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((acc[e] - acc[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(_P))
        i = j
    return out


_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingles(words: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of k consecutive words of each row, sorted within it, and offsets by row.

    A row with fewer words, but not none, has one: that of its whole sequence.
    """
    count = np.bincount(row, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(count)])
    parts, rows = [], []
    if len(words) >= k:
        s = np.full(len(words) - k + 1, np.uint64(k))
        for d in range(k):
            s = (s ^ words[d : len(words) - k + 1 + d]) * _STEP
            s ^= s >> np.uint64(32)
        ok = row[: len(s)] == row[k - 1 :]
        parts.append(s[ok])
        rows.append(row[: len(s)][ok])
    for c in range(1, k):
        short = np.flatnonzero(count == c)
        if len(short):
            s = np.full(len(short), np.uint64(c))
            for d in range(c):
                s = (s ^ words[first[short] + d]) * _STEP
                s ^= s >> np.uint64(32)
            parts.append(s)
            rows.append(short)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(n_rows + 1, np.int64)
    s, r = np.concatenate(parts), np.concatenate(rows)
    if len(parts) > 1:
        order = np.argsort(r, kind="stable")
        s, r = s[order], r[order]
    s = mix(s)
    offs = np.searchsorted(r, np.arange(n_rows + 1))
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        if b - a > 1:
            s[a:b].sort()
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    s, r = s[keep], r[keep]
    return s, np.searchsorted(r, np.arange(n_rows + 1))


def word_hashes(col: pa.Array, inside: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For blocks of rows: first row, number of rows, word hashes and the row (in the block) of each."""
    data, offs = buffers(col)
    for i, j in blocks(offs):
        a = offs[i]
        starts, ends, row = spans(data[a : offs[j]], offs[i : j + 1] - a, inside)
        yield i, j - i, hashes(data[a : offs[j]], starts, ends), row

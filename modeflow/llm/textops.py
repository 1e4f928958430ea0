"""Vectorised text helpers over Arrow string columns: words, 64-bit word hashes and shingles, many documents at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step takes (a longer document is a step of its own).
STEP_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_ZERO = np.zeros(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and odd multiplications)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_powers = {"n": 0}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
            up[0] = down[0] = 1
            np.cumprod(up, out=up)
            np.cumprod(down, out=down)
        if size > 4 * STEP_BYTES:
            return up, down
        _powers.update(n=size, up=up, down=down)
    return _powers["up"], _powers["down"]


def steps(texts: pa.Array, size: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of consecutive rows of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = int(np.searchsorted(offs, offs[i] + size, "right")) - 1
        j = min(max(j, i + 1), len(texts))
        yield i, j - i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the row each belongs to."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, segment: int = 1 << 18) -> np.ndarray:
    """64-bit hashes of the byte ranges, equal for equal bytes wherever they stand; the work goes in bounded segments."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        first = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, first + segment, "right")))
        part = low[first : ends[j - 1]]
        up, down = powers(len(part) + 1)
        a, b = starts[i:j] - first, ends[i:j] - first
        with np.errstate(over="ignore"):
            sums = np.concatenate([_ZERO, np.cumsum(_BYTE[part] * up[: len(part)])])
            out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return out


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed k-word shingles of each row, in ascending order; with 1 to k-1 words, the whole sequence as one.

    Returns the hashes and the offsets of the rows.
    """
    counts = np.bincount(rows, minlength=n_rows)
    out, owner = [], []
    with np.errstate(over="ignore"):
        if len(hashes) >= k:
            h = np.zeros(len(hashes) - k + 1, np.uint64)
            for i in range(k):
                h = mix(h * np.uint64(0x9FB21C651E98DF25) + hashes[i : len(hashes) - k + 1 + i] + np.uint64(i + 1))
            whole = rows[: len(h)] == rows[k - 1 :]
            out.append(h[whole])
            owner.append(rows[: len(h)][whole])
        first = np.concatenate([[0], np.cumsum(counts)])
        for r in np.flatnonzero((counts > 0) & (counts < k)):
            h = np.full(1, counts[r], np.uint64)
            for x in hashes[first[r] : first[r + 1]]:
                h = mix(h * np.uint64(0xD6E8FEB86659FD93) + x)
            out.append(h)
            owner.append(np.array([r]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(n_rows + 1, np.int64)
    h, r = np.concatenate(out), np.concatenate(owner)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(r, minlength=n_rows))])

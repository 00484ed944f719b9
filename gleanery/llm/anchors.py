"""Content-defined anchors of byte windows: where equal windows choose equal places.

Every LENGTH-byte window picks the leftmost of its GRAM-byte grams with the
least hash.  Two equal windows pick the same gram at the same distance, so equal
windows anywhere meet at anchors of equal gram, of which there is about one in
(LENGTH - GRAM) / 2 bytes.
"""

from __future__ import annotations

import numpy as np

from .textcore import mix

LENGTH = 200
GRAM = 64
_M = np.uint64(0x9FB21C651E98DF25)
_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """The hash of the GRAM bytes from each place on (n - GRAM + 1 of them), by doubling."""
    h, m, factor = _BYTE[data[:n]], 1, int(_M)
    while m < GRAM:
        h = h[:-m] * np.uint64(factor) + h[m:]
        factor, m = factor * factor % (1 << 64), 2 * m
    return mix(h)


def window_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive keys, in two running minima per block."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(keys)] = keys
    block = padded.reshape(-1, width)
    head = np.minimum.accumulate(block, axis=1).ravel()
    tail = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, place of the gram, first and last window start that pick it, gram hash, hash of all bytes of those windows)."""
    n = int(offsets[-1])
    none = np.zeros(0, np.int64)
    count = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    if not count.any():
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    h = gram_hashes(data, n)
    keys = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    pick = (window_least(keys, LENGTH - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.repeat(offsets[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    picked = pick[valid]
    new = np.flatnonzero(np.concatenate([[True], picked[1:] != picked[:-1]]))
    first, last, at = valid[new], valid[np.append(new[1:], len(valid)) - 1], picked[new]
    end = last + LENGTH - GRAM
    context = (last - first).astype(np.uint64)
    for k in range(-(-(2 * LENGTH - GRAM) // GRAM)):
        context = mix((context ^ h[np.minimum(first + GRAM * k, end)]) * _M)
    row = np.searchsorted(offsets, first, "right") - 1
    base = offsets[row]
    return row, at - base, first - base, last - base, h[at], context

"""Word shingles of many texts at once, as 64-bit hashes.

Words are runs of bytes that are not ASCII white space, after A-Z became a-z. A text's set holds the distinct shingles of
a given number of words; with fewer words it is the whole sequence as one; without words it is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .bytestrings import mixed, packs, prefix_sums, span_hash

_PIECE = 1 << 20
_STEP = np.uint64(0xA24BAED4963EE407)


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; off are the rows' offsets in data."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    solid = ~space
    start = np.flatnonzero(solid & (edge[:-1] | np.append(True, space[:-1])))
    end = np.flatnonzero(solid & (edge[1:] | np.append(space[1:], True))) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes) for every row."""
    for i, j in packs(np.diff(off), _PIECE):
        lo, hi = int(off[i]), int(off[j])
        part = data[lo:hi]
        part = part + ((part >= 65) & (part <= 90)).astype(np.uint8) * np.uint8(32)
        here = off[i : j + 1] - lo
        start, end, row = words_of(part, here)
        word = span_hash(prefix_sums(part), start, end)
        count = np.bincount(row, minlength=j - i)
        first = np.cumsum(count) - count
        # h[k] stands for words k .. k+words-1; those that cross into the next row are left out below
        n = max(0, len(word) - words + 1)
        h = np.zeros(n, np.uint64)
        for k in range(words):
            h = h * _STEP + word[k : k + n]
        h = mixed(h)
        for r in range(j - i):
            c, f = int(count[r]), int(first[r])
            if c >= words:
                yield i + r, np.unique(h[f : f + c - words + 1])
            elif c:
                x = np.uint64(c)
                with np.errstate(over="ignore"):
                    for k in range(c):
                        x = x * _STEP + word[f + k]
                yield i + r, mixed(np.array([x], np.uint64))
            else:
                yield i + r, np.zeros(0, np.uint64)

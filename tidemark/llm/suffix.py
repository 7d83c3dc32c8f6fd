"""Suffix order of an integer text, by sorting packed ranks."""

from __future__ import annotations

import numpy as np

# Two ranks and a position fit in 63 bits below this length.
PACKED = 1 << 21


def _ranked(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Dense rank of every pair (high, low)."""
    n = len(high)
    if n < PACKED and int(high.max(initial=0)) < PACKED and int(low.max(initial=0)) < PACKED:
        packed = np.sort((high.astype(np.int64) << 42) | (low.astype(np.int64) << 21) | np.arange(n))
        order, keys = packed & (PACKED - 1), packed >> 21
    else:
        order = np.lexsort((low, high))
        keys = None
    new = np.ones(n, bool)
    if keys is not None:
        new[1:] = keys[1:] != keys[:-1]
    else:
        h, w = high[order], low[order]
        new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new)
    return rank


def suffix_order(text: np.ndarray, depth: int, levels: list[tuple[int, np.ndarray]] | None = None) -> np.ndarray:
    """Positions of `text` in the order of the suffixes, compared over `depth`
    values at least; values are 0 or more, and the end counts as smaller.
    `levels` collects the ranks of all substrings of 1, 2, 4, ... values."""
    n = len(text)
    rank, span = np.asarray(text, np.int64) + 1, 1
    if not n:
        return np.zeros(0, np.int64)
    if int(rank.max()) >= PACKED:
        rank = _ranked(rank, np.zeros(n, np.int64))
    while span < depth:
        if levels is not None:
            levels.append((span, rank.astype(np.int32)))
        later = np.zeros(n, np.int64)
        if span < n:
            later[:-span] = rank[span:]
        rank, span = _ranked(rank, later), span * 2
        if int(rank.max()) == n:
            break
    if n < PACKED:
        return np.sort((rank << 21) | np.arange(n)) & (PACKED - 1)
    return np.argsort(rank, kind="stable")


def shared_prefix(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values agree at the places `a` and `b`, up to all levels together."""
    length = np.zeros(len(a), np.int64)
    for span, rank in reversed(levels):
        n = len(rank)
        x, y = a + length, b + length
        same = (x < n) & (y < n) & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)])
        length[same] += span
    return length


def search(text: np.ndarray, order: np.ndarray, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By binary search over the suffix order: for each pattern, the range of
    suffixes that start with its first `lengths` values."""
    m, width = patterns.shape
    padded = np.concatenate([text, np.full(width, -1, text.dtype)])
    step, use = np.arange(width), np.arange(width) < lengths[:, None]
    found = []
    for upper in (False, True):
        low, high = np.zeros(m, np.int64), np.full(m, len(order), np.int64)
        while (open_ := low < high).any():
            middle = np.where(open_, (low + high) >> 1, 0)
            here = padded[order[middle][:, None] + step] if len(order) else np.zeros_like(patterns)
            differ = (here != patterns) & use
            first = differ.argmax(1)
            rows = np.arange(m)
            less = differ.any(1) & (here[rows, first] < patterns[rows, first])
            if upper:
                less |= ~differ.any(1)
            low = np.where(open_ & less, middle + 1, low)
            high = np.where(open_ & ~less, middle, high)
        found.append(low)
    return found[0], found[1]

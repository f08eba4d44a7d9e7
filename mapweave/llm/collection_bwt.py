"""Burrows-Wheeler transform and common prefixes of a collection, column by column.

Every round puts one more symbol of each string, from its end, in front of the
suffix that went in the round before: its row follows from the rank of the symbol
in the transform so far, and its common prefix with the row before from the least
one between two rows with that symbol. A round reads the three columns (transform,
common prefix, place) once from start to end and writes them with the new rows.
"""

from __future__ import annotations

import numpy as np

#: Common prefixes are held in a byte.
LONGEST = 255


def _least(lcp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least value of lcp[start:end] for ranges sorted by their end, none of them empty."""
    if not len(start):
        return np.zeros(0, lcp.dtype)
    # From last to first, so that reduceat reads nothing between two ranges.
    cut = np.empty(2 * len(start), np.int64)
    cut[::2], cut[1::2] = start[::-1], end[::-1]
    return np.minimum.reduceat(np.append(lcp, lcp.dtype.type(0)), cut)[::2][::-1]


def sorted_suffixes(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, lcp) of all suffixes in order; lcp (at most 255) is that with the one before.

    Equal suffixes stand in order of their strings, and the empty ones come first.
    """
    n = len(strings)
    sizes = np.array([len(s) for s in strings], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes + 1)))  # one place more for each empty suffix
    text = np.frombuffer(b"\0".join([*strings, b""]), np.uint8).astype(np.uint16)
    before = np.zeros(len(text) + 1, np.uint16)  # the symbol before each place, from 1; 0 before a string
    before[1:] = text + 1
    before[first[:-1]] = 0
    if before.max(initial=0) < 256:
        before = before.astype(np.uint8)
    place = (first[1:] - 1).astype(np.int32 if len(text) < 1 << 31 else np.int64)
    bwt, lcp, new = before[place], np.zeros(n, np.uint8), np.arange(n)
    while True:
        order = np.argsort(bwt, kind="stable")
        done = int(np.count_nonzero(bwt == 0))
        fresh = np.zeros(len(bwt), bool)
        fresh[new] = True
        k = np.flatnonzero(fresh[order[done:]]) + done
        if not len(k):
            break
        rows = order[k]
        # New rows, and the rows behind them, get their common prefix from the rows that they extend.
        both = np.zeros(len(bwt) + 1, bool)
        both[k] = both[k + 1] = True
        target = np.flatnonzero(both[:-1])
        target = target[target > done]
        last, this = order[target - 1], order[target]
        alike = bwt[last] == bwt[this]
        size = len(bwt) + len(k)
        old = np.ones(size, bool)
        new = k - done + n
        old[new] = False
        columns = []
        came = place[rows] - 1
        for column, values in ((bwt, before[came]), (lcp, 0), (place, came)):
            grown = np.empty(size, column.dtype)
            grown[old] = column
            grown[new] = values
            columns.append(grown)
        grown = columns[1]
        grown[target - done + n] = 0
        least = _least(lcp, last[alike] + 1, this[alike] + 1).astype(np.int64)
        grown[target[alike] - done + n] = np.minimum(least + 1, LONGEST)
        bwt, lcp, place = columns
    string = np.searchsorted(first, place, "right") - 1
    return string, place - first[string], lcp


def equal_windows(strings: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, group) of every window; equal windows are in one group, numbered upwards."""
    string, start, lcp = sorted_suffixes(strings)
    sizes = np.array([len(s) for s in strings], np.int64)
    group = np.cumsum(lcp < window)
    whole = np.flatnonzero(sizes[string] - start >= window)
    return string[whole], start[whole], group[whole]

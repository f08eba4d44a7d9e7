"""Locally consistent parsing of word sequences by recompression.

Every round gives each symbol a side, left or right, by a hash of its name, and
replaces each left symbol with the right symbol that follows it by one new
symbol, named by a hash of both names. Equal neighbours have equal sides and
never pair; long runs of one word are named as runs instead (`run_lengths`).
Names come from hashes alone, so all tasks name alike.

For each symbol the range of words that fixes it is kept (its own words and the
neighbours it was compared with). A window that contains this range holds the
symbol wherever the window occurs. After 4 rounds a symbol has at most 16 words
and a border disturbs at most 15, so a window of 31 words or more holds at
least one such symbol.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from mapweave.llm.common import Powers, mix64, prefix_hash, range_hash, word_bounds

ROUNDS = 4
_BYTE = (Powers(0x9E3779B97F4A7C15), Powers(0xC2B2AE3D27D4EB4F))
_WORD = (Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F))
#: Bytes hashed at a time; only one longer word exceeds it.
CHUNK_BYTES = 1 << 20


@dataclass
class Words:
    """Words of some texts in a row: byte bounds, two hashes each, first word of each text."""

    start: np.ndarray
    end: np.ndarray
    names: tuple[np.ndarray, np.ndarray]
    first: np.ndarray


def words_of(texts: list[bytes]) -> Words:
    data = np.frombuffer(b" ".join(texts), np.uint8)
    start, end = word_bounds(data)
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    names = tuple(np.empty(len(start), np.uint64) for _ in _BYTE)
    at = 0
    while at < len(start):
        stop = max(int(np.searchsorted(end, start[at] + CHUNK_BYTES)), at + 1)
        base = start[at]
        values = data[base:end[stop - 1]].astype(np.uint64) + np.uint64(1)
        for name, powers in zip(names, _BYTE):
            name[at:stop] = range_hash(prefix_hash(values, powers), start[at:stop] - base, end[at:stop] - base, powers)
        at = stop
    return Words(start, end, names, np.searchsorted(start, offsets))


@dataclass
class Symbols:
    """A parse: first word, word count and name of each symbol, and what fixes it."""

    at: np.ndarray
    size: np.ndarray
    name: np.ndarray
    low: np.ndarray
    high: np.ndarray


def parse(words: Words, rounds: int = ROUNDS) -> Symbols:
    n = len(words.start)
    name = words.names[0]
    at, size = np.arange(n), np.ones(n, np.int64)
    low, high = at, at + 1
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    for r in range(rounds):
        if not len(at):
            break
        left = (mix64(name + np.uint64((r + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1)) & np.uint64(1)).astype(bool)
        follows = np.append(text[1:] == text[:-1], False)
        pair = np.append(left[:-1] & ~left[1:], False) & follows
        second = np.append(False, pair[:-1])
        after = np.append(np.arange(1, len(at)), 0)
        before = after - 2
        before[-1] = len(at) - 2
        led = np.append(False, follows[:-1])
        # Without a neighbour the text's edge decides, which no window contains.
        new_high = np.where(pair, high[after], np.where(left, np.where(follows, high[after], words.first[text + 1] + 1), high))
        new_low = np.where(left, low, np.where(led, low[before], words.first[text] - 1))
        joined = mix64(name * np.uint64(0x9FB21C651E98DF25) + mix64(name[after] + np.uint64(r + 1)))
        keep = ~second
        size = np.where(pair, size + size[after], size)[keep]
        name = np.where(pair, joined, name)[keep]
        at, low, high, text = at[keep], new_low[keep], new_high[keep], text[keep]
    return Symbols(at, size, name, low, high)


def run_lengths(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """For each word, the equal words up to it and from it on, within its text."""
    n = len(words.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = words.names
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    new[words.first[:-1][words.first[:-1] < n]] = True
    edge = np.append(np.flatnonzero(new), n)
    run = np.cumsum(new) - 1
    index = np.arange(n)
    return index - edge[run] + 1, edge[run + 1] - index


@dataclass
class Blocks:
    """Stretches of windows that hold one chosen symbol.

    Block i holds the windows that start at words ``start[i]`` up to
    ``start[i] + count[i] - 1`` of text ``text[i]``. The key is a hash of all
    words of these windows, the anchor the name of the chosen symbol.
    """

    text: np.ndarray
    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    key: tuple[np.ndarray, np.ndarray]


def window_prefixes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    return tuple(prefix_hash(name, powers) for name, powers in zip(words.names, _WORD))


def hash_words(prefixes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(range_hash(p, start, end, powers) for p, powers in zip(prefixes, _WORD))


def blocks_of(words: Words, window: int, prefixes) -> Blocks:
    """The blocks of all windows but those inside a run that goes on before them.

    Each window chooses, among the symbols that it fixes, the longest, then the
    greatest by hash, then the first. A window of one repeated word whose run
    began two words earlier or more is left out: `in_run` knows it repeats.
    """
    if window < (2 << ROUNDS) - 1:
        raise ValueError("a window must have 31 words or more")
    sym = parse(words)
    lengths = np.diff(words.first)
    starts = np.flatnonzero(_is_start(words, window))
    starts = starts[~in_run(words, window)[starts]]
    lo = np.searchsorted(sym.low, starts)
    hi = np.searchsorted(sym.high, starts + window, side="right")
    rank = sym.size.astype(np.uint64) << np.uint64(59) | mix64(sym.name) >> np.uint64(5)
    best = [np.arange(len(sym.at))]
    span = 1
    while span * 2 <= window and span < len(best[-1]):
        a, b = best[-1][:-span], best[-1][span:]
        best.append(np.where(rank[a] >= rank[b], a, b))
        span *= 2
    chosen = np.empty(len(starts), np.int64)
    width = hi - lo
    for level, table in enumerate(best):
        mine = (width >= 1 << level) & (width < 2 << level)
        a, b = table[lo[mine]], table[hi[mine] - (1 << level)]
        chosen[mine] = np.where(rank[a] >= rank[b], a, b)
    new = np.ones(len(starts), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
    edge = np.append(np.flatnonzero(new), len(starts))
    first, count = starts[edge[:-1]], np.diff(edge)
    text = np.repeat(np.arange(len(lengths)), lengths)[first]
    return Blocks(text, first, count, sym.name[chosen[edge[:-1]]],
                  hash_words(prefixes, first, first + count - 1 + window))


def _is_start(words: Words, window: int) -> np.ndarray:
    """Whether a window starts at the word and ends within its text."""
    n = len(words.start)
    change = np.zeros(n + 1, np.int64)
    lengths = np.diff(words.first)
    fits = lengths >= window
    np.add.at(change, words.first[:-1][fits], 1)
    np.add.at(change, words.first[1:][fits] - window + 1, -1)
    return np.cumsum(change)[:n] > 0


def in_run(words: Words, window: int) -> np.ndarray:
    """Whether the window at a word is inside a run that began 2 words before or earlier."""
    back, on = run_lengths(words)
    return (back >= 3) & (on >= window)

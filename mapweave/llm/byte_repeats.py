"""Substring dedup by bytes: remove what a 100-byte string covers that starts earlier elsewhere.

The collection is sorted column by column (`collection_bwt.py`): each round puts
one symbol of every string into the Burrows-Wheeler transform and the common
prefixes. Rounds over whole texts would be as many as the longest text has bytes,
so the strings are fragments of at most 160 bytes that overlap by 99:

1. Every window of 100 bytes has an anchor, the least hash of its 40-byte strings;
   windows in a row with one anchor are a fragment. Equal windows have equal
   anchors, so only fragments that share one can repeat each other.
2. Anchors that occur once in the corpus are sorted out by a count and a join.
   Fragments of one content are merged, with the first place where it stands.
3. Contents that share an anchor with others are cut from the texts and sorted
   in batches of whole anchors, round by round. Common prefixes of 100 bytes and
   more give the groups of equal windows; the first place of each group is spared.
   An anchor of very many contents is not sorted: its windows are counted one by
   one, by 128 bits of hash.
4. All other windows of the fragments left are marked and cut from their texts.

What passes between the steps are tables in the shared folder. Contents are
named by 128 bits of hash until they are sorted by their bytes.

Defined cases: null is an empty text; a text of less than a window loses nothing.
A place is (doc_id, start, hash of the text): rows that share an id are one
document, a null id comes first, and rows that agree in id and text have the same
places, so none of them is earlier than the other. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.collection_bwt import LONGEST, equal_windows
from mapweave.llm.common import SLICE_BYTES, Powers, binary_texts, mix64, prefix_hash, range_hash, signed, slices
from mapweave.sources.tables import stage

WINDOW = 100
#: Bytes whose hash is an anchor.
ANCHOR = 40
#: Fragments of whole anchors are sorted together up to about this many bytes.
BATCH_BYTES = 1 << 17
#: Contents of one anchor that are sorted in one task; windows of the others are counted one by one.
SORTED_CONTENTS = 4096

_NONE_FIRST = -(1 << 63)
_SYMBOLS = mix64(np.arange(1, 257, dtype=np.uint64))
_POWERS = Powers(0x9E3779B97F4A7C15)
_OTHER_POWERS = Powers(0xC2B2AE3D27D4EB4F)


def _placed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE_FIRST))
    return docs.select(doc.alias("doc"), F.xxhash64(text).alias("print"), text.alias("text"), "doc_id")


def _sliding(values: np.ndarray, n: int, choose) -> np.ndarray:
    """The least or greatest of n values in a row, by doubling."""
    width = 1
    while 2 * width <= n:
        values = choose(values[:-width], values[width:])
        width *= 2
    return choose(values[:width - n], values[n - width:]) if width < n else values


def _segments(texts: list[bytes], window: int) -> Iterator[tuple[int, int, bytes]]:
    """(text, start, bytes): texts of at least a window, in parts that overlap by a window less one."""
    for i, text in enumerate(texts):
        for start in range(0, len(text) - window + 1, SLICE_BYTES):
            yield i, start, text[start:start + SLICE_BYTES + window - 1]


class Fragments:
    """Fragments of some segments: runs of windows with one anchor."""

    def __init__(self, parts: list[bytes], window: int, anchor: int) -> None:
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.window = window
        ends = np.cumsum([len(p) for p in parts])
        span = window - anchor + 1
        symbols = prefix_hash(_SYMBOLS[self.data], _POWERS)
        self.prefix = symbols
        _, down = _POWERS.upto(len(symbols))
        hashes = mix64((symbols[anchor:] - symbols[:-anchor]) * down[:len(symbols) - anchor])
        least = _sliding(hashes, span, np.minimum)
        inside = np.ones(len(least), bool)
        for end in ends[:-1].tolist():  # windows across two segments are none
            inside[end - window + 1:end] = False
        least[~inside] = 0
        windows = np.flatnonzero(inside)
        value = least[windows]
        new = np.ones(len(windows), bool)
        new[1:] = (value[1:] != value[:-1]) | (windows[1:] != windows[:-1] + 1)
        run = np.flatnonzero(new)
        length = np.diff(np.append(run, len(windows)))
        start = windows[run]
        twice = self._twice(hashes, least, start, length, span)
        # A run of a repeated anchor can be of any length; it is cut, since only the anchor has to agree.
        pieces = -(-length // span)
        offset = (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * span
        self.start = np.repeat(start, pieces) + offset
        self.count = np.minimum(np.repeat(length, pieces) - offset, span)
        self.anchor = np.repeat(value[run], pieces)
        self.twice = np.repeat(twice, pieces)
        self.segment = np.searchsorted(ends, self.start, "right")
        self.first = np.concatenate(([0], ends[:-1]))

    @staticmethod
    def _twice(hashes, least, start, length, span) -> np.ndarray:
        """Whether the anchor stands in a run more than once: only such a run can repeat itself."""
        padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
        place = np.flatnonzero(hashes == _sliding(padded, span, np.maximum))
        same = np.zeros(len(place) + 1, np.int64)
        same[2:] = np.cumsum(hashes[place[1:]] == hashes[place[:-1]])
        low = np.searchsorted(place, start)
        high = np.searchsorted(place, start + length + span - 1)
        return same[high] > same[np.minimum(low + 1, high)]

    def content(self) -> np.ndarray:
        return range_hash(self.prefix, self.start, self.start + self.count + self.window - 1, _POWERS)


def _fragments(texts: list[bytes], window: int, anchor: int) -> Iterator[tuple[np.ndarray, np.ndarray, Fragments]]:
    """(text, start in the text, fragments), some segments at a time."""
    segments = list(_segments(texts, window))
    for a, b in slices([s[2] for s in segments]):
        found = Fragments([s[2] for s in segments[a:b]], window, anchor)
        text, base = (np.array([s[i] for s in segments[a:b]], np.int64) for i in (0, 1))
        yield text[found.segment], base[found.segment] + found.start - found.first[found.segment], found


def _anchors(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [(f.anchor, f.twice) for *_, f in _fragments(binary_texts(batch.column(0)), window, anchor)]
            values = np.concatenate([np.zeros(0, np.uint64), *(a for a, _ in seen)])
            twice = np.concatenate([np.zeros(0, bool), *(t for _, t in seen)])
            values, at, n = np.unique(values, return_inverse=True, return_counts=True)
            many = (n > 1) | (np.bincount(at, twice, len(n)) > 0)
            yield pa.RecordBatch.from_arrays([pa.array(signed(values)), pa.array(many)], names=["anchor", "many"])

    return run


def _located(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, print_ = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for text, start, found in _fragments(binary_texts(batch.column(0)), window, anchor):
                at = start << 7 | found.twice.astype(np.int64) << 6 | found.count
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(found.anchor)), pa.array(signed(found.content())), pa.array(doc[text]),
                     pa.array(at), pa.array(print_[text])], names=["anchor", "content", "doc", "at", "print"])

    return run


def _bodies(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary_texts(batch.column(2))
            wanted = batch.column(3)
            size = wanted.value_lengths().to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(len(texts)), size)
            rows = wanted.flatten()
            at = rows.field(2).to_numpy(zero_copy_only=False)
            bodies = [texts[t][s:s + n] for t, s, n in zip(text.tolist(), (at >> 7).tolist(), ((at & 63) + window - 1).tolist())]
            yield pa.RecordBatch.from_arrays(
                [rows.field(0), rows.field(1), batch.column(0).take(pa.array(text)), rows.field(2),
                 batch.column(1).take(pa.array(text)), rows.field(3), pa.array(bodies, pa.binary())],
                names=["anchor", "content", "doc", "at", "print", "hot", "body"])

    return run


def _sorted_batches(window: int, limit: int):
    """Masks of the windows that stand first, from rows that come anchor by anchor."""
    def masks(rows: list[tuple]) -> pa.RecordBatch:
        bodies = [r[4] for r in rows]
        doc, at, print_ = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))
        string, start, group = equal_windows(bodies, window)
        place = (at >> 7)[string] + start
        order = np.lexsort((print_[string], place, doc[string], group))
        new = np.ones(len(order), bool)
        new[1:] = group[order][1:] != group[order][:-1]
        spared = np.zeros(len(rows), np.uint64)
        first = order[new]
        np.bitwise_or.at(spared, string[first], np.uint64(1) << start[first].astype(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at), pa.array(print_), pa.array(signed(spared))],
                                          names=["doc", "at", "print", "spared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own, size, anchor = [], {}, 0, None
        for batch in batches:
            for a, content, *row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if a != anchor:
                    held.extend(own.values())
                    own, anchor = {}, a
                    if size >= limit:
                        yield masks(held)
                        held, size = [], 0
                if content not in own:  # rows that agree in id and text bring it again
                    own[content] = (a, *row)
                    size += len(row[-1])
        held.extend(own.values())
        if held:
            yield masks(held)

    return run


def _single_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, at, print_ = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            bodies = batch.column(6).to_pylist()
            for a, b in slices(bodies):
                count = (at[a:b] & 63).astype(np.int64)
                data = _SYMBOLS[np.frombuffer(b"".join(bodies[a:b]), np.uint8)]
                row = np.repeat(np.arange(a, b), count)
                i = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = np.repeat(np.cumsum(count + window - 1) - count - window + 1, count) + i
                hashes = [range_hash(prefix_hash(data, p), start, start + window, p) for p in (_POWERS, _OTHER_POWERS)]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(signed(h)) for h in hashes), pa.array(doc[row]), pa.array((at[row] >> 7) + i),
                     pa.array(print_[row]), pa.array(at[row]), pa.array(i)],
                    names=["w1", "w2", "doc", "place", "print", "at", "i"])

    return run


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, sorted_contents: int = SORTED_CONTENTS) -> DataFrame:
    """(doc, print, ats, spared): per text the fragments that repeat, and their windows that stand first."""
    if not anchor <= window <= min(LONGEST, anchor + 62):
        raise ValueError(f"a window of {window} bytes and anchors of {anchor} do not fit a mask of 63 windows")
    placed = _placed(docs)
    often = stage(placed.select("text").mapInArrow(_anchors(window, anchor), "anchor long, many boolean")
                  .groupBy("anchor").agg(F.count("*").alias("n"), F.max("many").alias("many"))
                  .filter("n > 1 or many").select("anchor"), "bytes-anchors")
    located = stage(placed.select("text", "doc", "print").mapInArrow(
        _located(window, anchor), "anchor long, content long, doc long, at long, print long")
        .join(often, "anchor", "left_semi"), "bytes-fragments")
    first = F.min(F.struct("doc", "at", "print"))
    contents = stage(located.groupBy("anchor", "content").agg(first.alias("first"), F.count("*").alias("n")).select(
        "anchor", "content", "first.*", "n"), "bytes-contents")
    twice = F.col("at").bitwiseAND(64) > 0
    anchors = stage(contents.groupBy("anchor").agg(F.count("*").alias("contents"), F.max(twice).alias("twice"))
                    .filter("contents > 1 or twice").select("anchor", (F.col("contents") > sorted_contents).alias("hot")),
                    "bytes-shared")
    shared = contents.join(anchors, "anchor")
    wanted = shared.groupBy("doc", "print").agg(F.collect_list(F.struct("anchor", "content", "at", "hot")).alias("wanted"))
    bodies = stage(placed.select("doc", "print", "text").join(wanted, ["doc", "print"]).mapInArrow(
        _bodies(window), "anchor long, content long, doc long, at long, print long, hot boolean, body binary"), "bytes-bodies")
    ordered = bodies.filter("not hot").select("anchor", "content", "doc", "at", "print", "body").repartition(
        "anchor").sortWithinPartitions("anchor")
    masks = "doc long, at long, print long, spared long"
    in_order = stage(ordered.mapInArrow(_sorted_batches(window, BATCH_BYTES), masks), "bytes-sorted")
    # The earliest window of each kind, in whichever content it stands.
    earliest = bodies.filter("hot").mapInArrow(
        _single_windows(window), "w1 long, w2 long, doc long, place long, print long, at long, i long").groupBy(
        "w1", "w2").agg(F.min(F.struct("doc", "place", "print", "at", "i")).alias("first")).select("first.*")
    counted = earliest.groupBy("doc", "at", "print").agg(F.bit_or(F.expr("shiftleft(1L, cast(i as int))")).alias("spared"))
    alone = contents.filter("n > 1").join(anchors, "anchor", "left_anti").select(
        "doc", "at", "print", F.lit(-1).cast("long").alias("spared"))
    spared = in_order.union(counted).union(alone)
    marks = located.select("doc", "at", "print", F.lit(None).cast("long").alias("spared")).union(spared)
    is_spared = F.col("spared").isNotNull()
    return marks.groupBy("doc", "print").agg(
        F.collect_set(F.when(~is_spared, F.col("at"))).alias("ats"),
        F.collect_set(F.when(is_spared, F.struct("at", "spared"))).alias("spared"))


def _remover(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary_texts(batch.column(0))
            for a, b in slices(texts):
                yield _removed(batch.slice(a, b - a), texts[a:b], window)

    return run


def _flat(column: pa.Array, base: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The first byte of the text of each list entry, and the entries."""
    size = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.repeat(base, size), column.flatten()


def _removed(batch: pa.RecordBatch, texts: list[bytes], window: int) -> pa.RecordBatch:
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    first = np.concatenate(([0], ends[:-1]))
    steps = np.zeros(len(data) + 1, np.int32)
    base, at = _flat(batch.column(2), first)
    at = at.to_numpy(zero_copy_only=False).astype(np.int64)
    start = base + (at >> 7)
    np.add.at(steps, start, 1)
    np.add.at(steps, start + (at & 63), -1)
    starts = np.cumsum(steps[:-1], dtype=np.int32) > 0
    base, rows = _flat(batch.column(3), first)
    at, spared = (rows.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    start, count, spared = base + (at >> 7), at & 63, spared.view(np.uint64)
    for i in range(int(count.max(initial=0))):
        keep = (count > i) & (spared >> np.uint64(i) & np.uint64(1)).astype(bool)
        starts[start[keep] + i] = False
    total = np.concatenate((np.zeros(window, np.int32), np.cumsum(starts, dtype=np.int32)))
    gone = total[window:] > total[:-window]
    left = np.concatenate(([0], np.cumsum(~gone)))
    opens = gone.copy()
    opens[1:] &= ~gone[:-1]
    opens[first[first < len(data)]] = gone[first[first < len(data)]]
    spans = np.concatenate(([0], np.cumsum(opens)))
    kept = pa.Array.from_buffers(pa.binary(), len(texts), [
        None, pa.py_buffer(np.append(left[first], left[-1]).astype(np.int32)), pa.py_buffer(data[~gone].tobytes())])
    n_kept = left[ends] - left[first]
    return pa.RecordBatch.from_arrays(
        [batch.column(1), pa.array(ends - first), pa.array(ends - first - n_kept), pa.array(spans[ends] - spans[first]), kept],
        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR,
                   sorted_contents: int = SORTED_CONTENTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): the bytes left of each text."""
    marks = repeats(docs, window, anchor, sorted_contents)
    joined = _placed(docs).join(marks, ["doc", "print"], "left").select("text", "doc_id", "ats", "spared")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_remover(window), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")

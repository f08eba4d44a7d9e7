"""Substring dedup: remove words inside windows that occur more than once.

Texts are parsed by recompression (`recompression.py`), so equal substrings hold
equal interior symbols. Each window chooses one symbol that it alone fixes, and
neighbouring windows with one choice form a block. Then, over all documents:

1. symbols chosen in one block only are sorted out by a bit table of fixed size
   (a false hit costs work, not results);
2. the other blocks are counted by a hash of all their words: a block that
   occurs twice repeats with all its windows;
3. where blocks with different words share a symbol (the borders of a repeat),
   their windows are counted one by one, once for each different block.

Copies of a block are counted before the shuffle, so a passage that a third of
the documents share is one row per task. Windows inside a long run of one word
are known to repeat from the run itself. Keys are hashes of 96 bits of the whole
word sequence.

Defined cases: null text has no words; texts shorter than the window lose
nothing; repeated rows are occurrences like any other; a null doc_id is kept,
and marks belong to a text (128 bits of hash), however many rows share an id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm import recompression as rc
from mapweave.llm.common import binary_texts, signed, slices
from mapweave.sources.tables import stage

WINDOW = 35
#: Size of the table of symbols, as a power of two (2**27 bits are 16 MB).
TABLE_BITS = 27
_COUNT_BITS = 6


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    # Two hashes of the whole text name its marks; the id in one of them only spreads copies over tasks.
    return docs.select(F.xxhash64("doc_id", text).alias("key"), F.xxhash64(F.lit("text"), text).alias("print"),
                       text.alias("text"), F.col("doc_id"))


def _ab(blocks: rc.Blocks) -> np.ndarray:
    """The anchor in the upper half, half of the second hash in the lower one."""
    return blocks.anchor << np.uint64(32) | blocks.key[1] & np.uint64(0xFFFFFFFF)


def _slot(anchor: np.ndarray, bits: int) -> np.ndarray:
    return anchor & np.uint64((1 << min(bits, 32)) - 1)


def _hit(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (table[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63)) & np.uint64(1)).astype(bool)


def _bit_table(slots: DataFrame, bits: int) -> np.ndarray:
    """A table of 2**bits bits from distinct slots; its size does not depend on them."""
    rows = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(1 << bits - 6, np.uint64)
    table[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return table


def _parsed(batch: pa.RecordBatch, window: int):
    texts = binary_texts(batch.column(0))
    for a, b in slices(texts):
        words = rc.words_of(texts[a:b])
        prefixes = rc.window_prefixes(words)
        yield a, words, prefixes, rc.blocks_of(words, window, prefixes)


def _chosen_slots(window: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_slot(blocks.anchor, bits) for *_, blocks in _parsed(batch, window)]
            slot, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(slot)), pa.array(np.minimum(n, 2))], names=["slot", "n"])

    return run


def _shared_blocks(shipped, window: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(1).to_numpy(zero_copy_only=False)
            prints = batch.column(2).to_numpy(zero_copy_only=False)
            for a, words, _, blocks in _parsed(batch, window):
                keep = np.flatnonzero(_hit(shipped.value, _slot(blocks.anchor, bits)))
                text = blocks.text[keep]
                start = blocks.start[keep] - words.first[text]
                at = start.astype(np.uint64) << np.uint64(_COUNT_BITS) | blocks.count[keep].astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[a + text]), pa.array(prints[a + text]), pa.array(signed(at)),
                     pa.array(signed(blocks.key[0][keep])), pa.array(signed(_ab(blocks)[keep]))],
                    names=["key", "print", "at", "b1", "ab"])

    return run


def _border_windows(shipped, window: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words, prefixes, blocks in _parsed(batch, window):
                keep = np.flatnonzero(_hit(shipped.value, _slot(blocks.anchor, bits)))
                keep = keep[np.unique(blocks.key[0][keep], return_index=True)[1]]
                count = blocks.count[keep]
                offsets = np.concatenate(([0], np.cumsum(count)))
                start = np.repeat(blocks.start[keep] - offsets[:-1], count) + np.arange(offsets[-1])
                w1, w2 = rc.hash_words(prefixes, start, start + window)
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(w))
                         for w in (signed(w1), (w2 & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(blocks.key[0][keep])), pa.array(signed(_ab(blocks)[keep])), *lists],
                    names=["b1", "ab", "w1", "w2"])

    return run


def repeated_blocks(docs: DataFrame, window: int = WINDOW, table_bits: int = TABLE_BITS) -> DataFrame:
    """(key, print, at, mask): per block with repeated windows, a bit for each of them."""
    context = docs.sparkSession.sparkContext
    keyed = _keyed(docs)
    texts = keyed.select("text")
    chosen = texts.mapInArrow(_chosen_slots(window, table_bits), "slot long, n long")
    often = chosen.groupBy("slot").agg(F.sum("n").alias("n")).filter("n > 1")
    table = context.broadcast(_bit_table(often, table_bits))
    blocks = stage(keyed.select("text", "key", "print").mapInArrow(
        _shared_blocks(table, window, table_bits), "key long, print long, at long, b1 long, ab long"), "repeat-blocks")
    contents = stage(blocks.groupBy("b1", "ab").count(), "repeat-contents")
    slot = F.shiftrightunsigned("ab", 32).bitwiseAND((1 << min(table_bits, 32)) - 1).alias("slot")
    mixed = contents.groupBy(slot).agg(F.count("*").alias("n")).filter("n > 1")
    borders = context.broadcast(_bit_table(mixed, table_bits))
    edges = stage(texts.mapInArrow(_border_windows(borders, window, table_bits),
                                   "b1 long, ab long, w1 array<long>, w2 array<int>")
                  .groupBy("b1", "ab").agg(F.first("w1").alias("w1"), F.first("w2").alias("w2")), "repeat-borders")
    single = edges.select("b1", "ab", "w2", F.posexplode("w1").alias("i", "w1")).select(
        "w1", F.expr("w2[i]").alias("w2"), "b1", "ab", "i")
    # Written, so that the joins deal out both sides anew and a hot key is split.
    twice = stage(single.groupBy("w1", "w2").count().filter("count > 1").select("w1", "w2"), "repeat-windows")
    partly = single.join(twice, ["w1", "w2"], "left_semi").groupBy("b1", "ab").agg(
        F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask"))
    wholly = contents.filter("count > 1").select("b1", "ab", F.lit(-1).cast("long").alias("mask"))
    verdict = stage(wholly.union(partly).groupBy("b1", "ab").agg(F.bit_or("mask").alias("mask")), "repeat-verdict")
    return blocks.join(verdict, ["b1", "ab"]).select("key", "print", "at", "mask")


def marks(found: DataFrame) -> DataFrame:
    """(key, print, at, mask): the marks of one text, once for all its copies.

    Equal texts have equal marks, and sets of them are merged before the shuffle.
    """
    return found.groupBy("key", "print").agg(F.collect_set(F.struct("at", "mask")).alias("marks")).select(
        "key", "print", F.col("marks.at").alias("at"), F.col("marks.mask").alias("mask"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, table_bits: int = TABLE_BITS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words left, joined by one space."""
    per_text = marks(repeated_blocks(docs, window, table_bits))
    joined = _keyed(docs).join(per_text, ["key", "print"], "left").select("text", "doc_id", "at", "mask")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_remover(window), f"doc_id {kind}, n_words long, n_removed long, kept string")


def _remover(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary_texts(batch.column(0))
            n_words, n_removed, kept = [], [], []
            for a, b in slices(texts):
                words = rc.words_of(texts[a:b])
                starts = rc.in_run(words, window)
                at, mask = (batch.column(i).slice(a, b - a) for i in (2, 3))
                size = np.nan_to_num(at.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                at, mask = (x.flatten().to_numpy(zero_copy_only=False).view(np.uint64) for x in (at, mask))
                text = np.repeat(np.arange(b - a), size)
                first = words.first[text] + (at >> np.uint64(_COUNT_BITS)).astype(np.int64)
                count = (at & np.uint64((1 << _COUNT_BITS) - 1)).astype(np.int64)
                for i in range(int(count.max(initial=0))):
                    set_ = (count > i) & (mask >> np.uint64(i) & np.uint64(1)).astype(bool)
                    starts[first[set_] + i] = True
                gone = _cover(starts, window)
                total = np.concatenate(([0], np.cumsum(gone)))
                for t, f, e in zip(texts[a:b], words.first[:-1].tolist(), words.first[1:].tolist()):
                    out = int(total[e] - total[f])
                    n_words.append(e - f)
                    n_removed.append(out)
                    kept.append(b" ".join(compress(t.split(), (~gone[f:e]).tolist()) if out else t.split()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def _cover(starts: np.ndarray, window: int) -> np.ndarray:
    """Words inside a window that starts at a marked word."""
    total = np.concatenate((np.zeros(window, np.int64), np.cumsum(starts)))
    return total[window:] > total[:-window]

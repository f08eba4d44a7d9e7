"""Benchmark decontamination with a generalised suffix automaton of test items.

The items are cut into blocks of bounded size. Each block is one automaton that
is shipped to the tasks; documents stream through it word by word while the
length of the longest match is tracked. A match as long as the window marks the
window's words. Nothing is shuffled.

Defined cases: a null or word-less text has no words and no hits; null and
word-less items never occur; an item shorter than the window is one window;
repeated items count once per id, repeated document rows stay repeated; with no
items at all nothing is hit; other columns of the documents pass untouched.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapweave.llm.automaton import SuffixAutomaton
from mapweave.llm.common import binary_texts, ship, unpack
from mapweave.sources.tables import stage

WINDOW = 10
#: Words of one automaton; bounds what is shipped to a task (about 100 MB).
BLOCK_WORDS = 150_000
#: Longer items are cut into pieces that overlap by a window less one word.
PIECE_WORDS = 5_000
#: Automata that one job streams through before the marks are written.
BLOCKS_PER_JOB = 3

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")

N_WORDS, MARKS, ITEMS = "_llm_n_words", "_llm_marks", "_llm_items"
_MARK_FIELDS = [
    T.StructField(N_WORDS, T.LongType()),
    T.StructField(MARKS, T.ArrayType(T.LongType())),
    T.StructField(ITEMS, T.ArrayType(T.StringType())),
]


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters and digits (ASCII lower-cased) and of non-ASCII bytes."""
    return text.translate(_FOLD).split()


class ItemIndex:
    """Automaton of one block of items with what each state tells about items."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        sequences = []
        for item, text in items:
            words = words_of(text)
            if words:
                sequences.append((item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]))
        auto = self.auto = SuffixAutomaton()
        for _, seq in sequences:
            auto.add(seq)
        self.shortest = min([window, *(len(s) for _, s in sequences)]) if sequences else window
        # The state of the window-long suffix, and the items in which it occurs.
        order = sorted(range(len(auto.size)), key=auto.size.__getitem__)
        self.window_state = [-1] * len(auto.size)
        for s in order[1:]:
            if auto.size[s] >= window:
                up = auto.link[s]
                self.window_state[s] = s if auto.size[up] < window else self.window_state[up]
        held: dict[int, set] = defaultdict(set)
        short: dict[int, list] = defaultdict(list)
        for item, seq in sequences:
            last = 0
            for n, last in enumerate(auto.walk(seq), 1):
                if n >= window:
                    held[self.window_state[last]].add(item)
            if len(seq) < window:
                short[last].append((len(seq), item))
        self.held, self.short = dict(held), dict(short)
        # The nearest state on the way of suffix links that ends a short item.
        self.short_from = [-1] * len(auto.size)
        if short:
            for s in order[1:]:
                self.short_from[s] = s if s in short else self.short_from[auto.link[s]]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Ranges of words inside occurrences (in order of their ends) and items."""
        found: list[tuple[int, int]] = []
        items: set = set()
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.empty(len(ids) + 2, bool)
        known[0] = known[-1] = False
        np.greater_equal(ids, 0, out=known[1:-1])
        edge = np.flatnonzero(known[1:] != known[:-1])
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if end - start >= self.shortest:
                self._run(ids[start:end].tolist(), start, found, items)
        return found, items

    def _run(self, run: list[int], start: int, found: list, items: set) -> None:
        step, link, size = self.auto.step, self.auto.link, self.auto.size
        state = length = 0
        for at, symbol in enumerate(run, start + 1):
            while state and symbol not in step[state]:
                state = link[state]
                length = size[state]
            if symbol in step[state]:
                state = step[state][symbol]
                length += 1
            if length >= self.window:
                items.update(self.held[self.window_state[state]])
                found.append((at - self.window, at))
            ender = self.short_from[state]
            while ender > 0:
                for n, item in self.short[ender]:
                    if n <= length:
                        items.add(item)
                        found.append((at - n, at))
                ender = self.short_from[link[ender]]


def covered(ranges) -> list[int]:
    """Flat start, end list of the union of ranges."""
    out: list[int] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _item_blocks(items: DataFrame, window: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items as pieces in blocks, fetched block by block when there are several."""
    pieces_schema = "item string, n long, piece binary"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), binary_texts(batch.column(1))):
                words = words_of(text)
                step = PIECE_WORDS - window + 1
                for s in range(0, max(len(words) - window + 1, 1), step):
                    part = words[s:s + PIECE_WORDS]
                    if part:
                        rows.append((item, len(part), b" ".join(part)))
            yield pa.RecordBatch.from_pydict(
                {"item": [r[0] for r in rows], "n": [r[1] for r in rows], "piece": [r[2] for r in rows]},
                schema=pa.schema([("item", pa.string()), ("n", pa.int64()), ("piece", pa.binary())]))

    picked = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    cut = stage(picked.mapInArrow(pieces, pieces_schema).distinct(), "benchmark-pieces")
    total = cut.agg(F.sum("n")).first()[0] or 0
    n_blocks = -(-total // BLOCK_WORDS)
    for b in range(n_blocks):
        part = cut.filter(F.pmod(F.xxhash64("item", "piece"), F.lit(n_blocks)) == b)
        yield [(r.item, bytes(r.piece)) for r in part.collect()]


def mark_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with word count, covered word ranges (flat) and item ids."""
    fields = [f for f in docs.schema.fields if f.name not in (N_WORDS, MARKS, ITEMS)]
    out_schema = T.StructType(fields + _MARK_FIELDS)
    at = [f.name for f in fields].index("text")
    spark = docs.sparkSession
    marked = docs
    for b, block in enumerate(_item_blocks(items, window)):
        shipped = ship(spark, ItemIndex(block, window))
        if b and b % BLOCKS_PER_JOB == 0:
            marked = stage(marked, "benchmark-marks")
        marked = marked.mapInArrow(_marker(shipped, at, len(fields)), out_schema)
    if MARKS not in marked.columns:
        marked = marked.mapInArrow(_marker(None, at, len(fields)), out_schema)
    return marked


def _marker(shipped, at: int, n_fields: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = unpack(shipped) if shipped else None
        for batch in batches:
            texts = binary_texts(batch.column(at))
            before = ([c.to_pylist() for c in batch.columns[n_fields + 1:]] if batch.num_columns > n_fields
                      else [[[]] * len(texts)] * 2)
            counts, marks, hit = [], [], []
            for text, old_marks, old_items in zip(texts, *before):
                words = words_of(text)
                found, items = index.scan(words) if index else ([], set())
                counts.append(len(words))
                marks.append(covered(found + list(zip(old_marks[::2], old_marks[1::2]))) if found else old_marks)
                hit.append(sorted(items.union(old_items) - {None}))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n_fields], pa.array(counts, pa.int64()), pa.array(marks, pa.list_(pa.int64())),
                 pa.array(hit, pa.list_(pa.string()))],
                names=[*batch.schema.names[:n_fields], N_WORDS, MARKS, ITEMS])

    return run


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, words inside item windows, and the items that occur."""
    marked = mark_documents(docs.select("doc_id", "text"), items, window)
    hit = F.aggregate(
        F.sequence(F.lit(1), F.floor(F.size(MARKS) / 2).cast("int")), F.lit(0).cast("long"),
        lambda total, i: total + F.element_at(MARKS, 2 * i) - F.element_at(MARKS, 2 * i - 1))
    n_hit = F.when(F.size(MARKS) > 0, hit).otherwise(F.lit(0).cast("long"))
    return marked.select(
        "doc_id", F.col(N_WORDS).alias("n_words"), n_hit.alias("n_hit"),
        F.size(ITEMS).cast("long").alias("n_items"),
        F.sha2(F.array_join(ITEMS, ","), 256).alias("items_sha256"),
        (F.size(MARKS) > 0).alias("contaminated"), F.col(ITEMS).alias("items"), F.col(MARKS).alias("marks"))


def remove_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                         coverage_limit: float = 0.5) -> DataFrame:
    """Documents without the covered words; mostly covered documents are dropped.

    A document goes when more than ``coverage_limit`` of its words are covered.
    Otherwise each covered stretch is cut from the text, from the first byte of
    its first word to the last byte of its last, and ``n_chars`` follows.
    """
    marked = mark_documents(docs, items, window)
    names = docs.columns
    at = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            marks = batch.column(len(names) + 1).to_pylist()
            counts = batch.column(len(names)).to_pylist()
            keep = []
            for i, (mark, n) in enumerate(zip(marks, counts)):
                keep.append(not mark or sum(mark[1::2]) - sum(mark[::2]) <= coverage_limit * n)
                if mark and keep[-1]:
                    texts[i] = _without(texts[i], mark)
            columns = list(batch.columns[:len(names)])
            columns[at] = pa.array(texts, pa.binary()).cast(batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    out = marked.mapInArrow(cut, docs.schema)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                             .otherwise(F.char_length("text")).cast(kind))
    return out


def _without(text: bytes, mark: list[int]) -> bytes:
    spans = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    kept, last = [], 0
    for start, end in zip(mark[::2], mark[1::2]):
        kept.append(text[last:spans[start][0]])
        last = spans[end - 1][1]
    return b"".join([*kept, text[last:]])

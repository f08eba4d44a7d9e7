"""SimHash near-dedup with a Gray-order hierarchical index.

Equal fingerprints are merged first. Fingerprints are then linked at up to
three differing bits through masked views: the 64 bits form five blocks, and
two fingerprints that close agree on at least two of them, so each of the ten
pairs of blocks is one view. A view groups fingerprints by the masked pattern
of its two blocks, the top node of the index. Inside a group the other bits are
sorted by Gray rank and split into nodes of a few bits per level; pairs of nodes
add up the bits in which their patterns differ, and a pair of whole groups is
dropped as soon as the sum exceeds the limit. A task gives each fingerprint one
link to the smallest one of its local component, never all pairs. Groups that
are too big for a task are split again by views of the remaining bits; after
that at most 2**25 distinct fingerprints can share a group.

Defined cases: a null or word-less text has fingerprint zero and is linked like
any other; fewer words than a shingle are one shingle; repeated rows stay
repeated; a null doc_id keeps its row and has the component of its fingerprint
(null only if no id is known there).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import binary_texts, id_and_text, popcount
from mapweave.llm.components import component_labels
from mapweave.sources.tables import stage

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Widths of the blocks of bits, most significant first; two agree within 3 bits.
BLOCKS = (13, 13, 13, 13, 12)
#: A group of more fingerprints than this is split by views of its other bits.
GROUP_LIMIT = 50_000
#: Bits of one level of the index, and pairs of nodes held at a time.
LEVEL_BITS = 4
PAIRS_AT_A_TIME = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, n: int = SHINGLE_WORDS) -> int:
    """64 bits, each set if set in over half the shingle hashes."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    count = max(len(words) - n + 1, 1)
    joined = b" ".join(words)
    if count == 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[s:e], SEED) for s, e in zip(starts[:count].tolist(), ends[n - 1:].tolist())), np.uint64, count)
    total = np.zeros(64, np.int64)
    for s in range(0, count, 1 << 16):
        part = hashes[s:s + (1 << 16)].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print, bits) for every row: id, hash of the text, fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary_texts(batch.column(1))
            bits = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bits)],
                                             names=["doc_id", "print", "bits"])

    rows = id_and_text(docs).withColumn("print", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, print long, bits long")


def _views(widths: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Bit orders that bring each pair of blocks to the front, and their widths."""
    starts = np.cumsum((0, *widths))
    out = []
    for pair in combinations(range(len(widths)), 2):
        rest = [b for b in range(len(widths)) if b not in pair]
        out.append(tuple((int(starts[b]), widths[b]) for b in (*pair, *rest)))
    return out


def _arranged(bits: np.ndarray, total: int, view) -> np.ndarray:
    """The low ``total`` bits with the blocks in the order of the view."""
    out = np.zeros(len(bits), np.uint64)
    for start, width in view:
        out = out << np.uint64(width) | bits >> np.uint64(total - start - width) & np.uint64((1 << width) - 1)
    return out


def _explode_views(total: int, widths: tuple[int, ...]):
    """One row per view: key = view, old key and masked pattern; rest = other bits."""
    views = _views(widths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, rest, bits = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
            for v, view in enumerate(views):
                front = view[0][1] + view[1][1]
                whole = _arranged(rest, total, view)
                # A key has 4 bits of view, then up to 26 bits of pattern; keys of an outer level stay in front.
                new_key = (key << np.uint64(20) if total < 64 else np.zeros_like(key)) | np.uint64(
                    v << front) | whole >> np.uint64(total - front)
                left = whole & np.uint64((1 << total - front) - 1) | np.uint64(total - front << 58)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(new_key.view(np.int64)), pa.array(left.view(np.int64)), batch.column(2)],
                    names=["key", "rest", "bits"])

    return run


def _gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a bit pattern in the reflected Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ x >> np.uint64(shift)
    return x


def linked(keys: np.ndarray, rest: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Index of the smallest row of each row's component within its key.

    Rows link at ``max_bits`` or fewer differing bits of ``rest``. Rows are
    sorted by key and Gray rank; runs that share leading bits are the nodes.
    """
    n = len(keys)
    order = np.lexsort((_gray_rank(rest), keys))
    keys, rest = keys[order], rest[order]
    root = np.arange(n)
    width = int(rest.max()).bit_length() if n else 0
    # Nodes of each level: runs with one key and one pattern of leading bits.
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    first, last = edge[:-1], edge[1:]
    many = last - first > 1
    first, last = first[many], last[many]
    levels = []
    for low in range(max(width - LEVEL_BITS, 0), -LEVEL_BITS, -LEVEL_BITS):
        shift = np.uint64(max(low, 0))
        levels.append((rest >> shift, np.concatenate((
            [True], (keys[1:] != keys[:-1]) | (rest[1:] >> shift != rest[:-1] >> shift), [True]))))
    bounds = [np.flatnonzero(cut) for _, cut in levels]
    same = np.zeros(len(first), np.int64)
    work = [(0, first, last, first, last, same)] if len(first) else []
    while work:
        level, f1, l1, f2, l2, diff = work.pop()
        if len(f1) > PAIRS_AT_A_TIME and len(f1) > 1:
            for part in np.array_split(np.arange(len(f1)), -(-len(f1) // PAIRS_AT_A_TIME)):
                work.append((level, f1[part], l1[part], f2[part], l2[part], diff[part]))
            continue
        if level == len(levels):
            _union(root, f1, f2)
            continue
        # Nodes whose rows are in one component already need no more links among them.
        open_ = (l1 - f1 > 1) | (l2 - f2 > 1) | (root[f1] != root[f2])
        f1, l1, f2, l2, diff = (x[open_] for x in (f1, l1, f2, l2, diff))
        if not len(f1):
            continue
        pattern, _ = levels[level]
        cuts = bounds[level]
        a0, a1 = np.searchsorted(cuts, f1), np.searchsorted(cuts, l1)
        b0, b1 = np.searchsorted(cuts, f2), np.searchsorted(cuts, l2)
        # Children are paired in slices, so that one wide pair of nodes stays bounded.
        per = (a1 - a0) * (b1 - b0)
        before = np.concatenate(([0], np.cumsum(per)))
        total = int(before[-1])
        pieces = []
        for s in range(0, total, PAIRS_AT_A_TIME):
            at = np.arange(s, min(s + PAIRS_AT_A_TIME, total))
            pair = np.searchsorted(before, at, side="right") - 1
            inner = at - before[pair]
            wide = (b1 - b0)[pair]
            i, j = a0[pair] + inner // wide, b0[pair] + inner % wide
            ok = i <= j
            i, j, pair = i[ok], j[ok], pair[ok]
            c1, c2 = cuts[i], cuts[j]
            d = diff[pair] + popcount(pattern[c1] ^ pattern[c2]) - _seen(levels, level, c1, c2)
            near = (d <= max_bits) & ((i != j) | (cuts[i + 1] - c1 > 1))
            i, j, d = i[near], j[near], d[near]
            if len(i):
                pieces.append((level + 1, cuts[i], cuts[i + 1], cuts[j], cuts[j + 1], d))
        work.extend(pieces)
    while True:
        up = root[root]
        if np.array_equal(up, root):
            break
        root = up
    out = np.empty(n, np.int64)
    out[order] = order[root]
    return out


def _seen(levels, level: int, c1: np.ndarray, c2: np.ndarray):
    """Differing bits that upper nodes have counted."""
    return popcount(levels[level - 1][0][c1] ^ levels[level - 1][0][c2]) if level else 0


def _union(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the components of a[i] and b[i]; a root is its smallest member."""
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star links within each key; rows of a key are adjacent in the task."""

    def stars(parts: list[np.ndarray]) -> pa.RecordBatch:
        key, rest, bits = (np.concatenate([p[i] for p in parts]) for i in range(3))
        at = linked(key, rest & np.uint64((1 << 58) - 1))
        a, b = bits[at].view(np.int64), bits.view(np.int64)
        lone = a == b
        low, high = np.minimum(a, b)[~lone], np.maximum(a, b)[~lone]
        return pa.RecordBatch.from_arrays([pa.array(high), pa.array(low)], names=["src", "dst"])

    held: list[np.ndarray] = []
    rows = 0
    for batch in batches:
        part = [batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3)]
        if not len(part[0]):
            continue
        held.append(part)
        rows += len(part[0])
        if rows >= 4 * GROUP_LIMIT:
            # The last key may go on in the next batch.
            key, rest, bits = (np.concatenate([p[i] for p in held]) for i in range(3))
            stop = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
            if stop:
                yield stars([[key[:stop], rest[:stop], bits[:stop]]])
            held = [[key[stop:], rest[stop:], bits[stop:]]]
            rows = len(key) - stop
    if held:
        yield stars(held)


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links (src, dst) that connect all ``bits`` within `MAX_BITS` of each other."""
    schema = "key long, rest long, bits long"
    seed = distinct.select(F.lit(0).cast("long").alias("key"), F.col("bits").alias("rest"), "bits")
    viewed = seed.mapInArrow(_explode_views(64, BLOCKS), schema)
    hot = viewed.groupBy("key").count().filter(F.col("count") > GROUP_LIMIT).select("key")
    hot = stage(hot, "simhash-hot-keys")
    links = None
    wide = viewed
    if hot.limit(1).count():
        wide = viewed.join(hot, "key", "left_anti")
        inner = viewed.join(hot, "key", "left_semi")
        for width in (38, 39):
            # The number of other bits depends on the two blocks of the view.
            part = inner.filter(F.shiftrightunsigned("rest", 58) == width).select(
                "key", F.col("rest").bitwiseAND((1 << 58) - 1).alias("rest"), "bits")
            blocks = (8, 8, 8, 7, 7) if width == 38 else (8, 8, 8, 8, 7)
            split = part.mapInArrow(_explode_views(width, blocks), schema)
            found = split.repartition("key").sortWithinPartitions("key").mapInArrow(_link_groups, "src long, dst long")
            links = found if links is None else links.union(found)
    found = wide.repartition("key").sortWithinPartitions("key").mapInArrow(_link_groups, "src long, dst long")
    return (found if links is None else links.union(found)).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_same, print, label): one row per document row.

    ``n_same`` rows have the same fingerprint; ``label`` names the component also
    where no id is known.
    """
    prints = stage(fingerprints(docs), "simhash-fingerprints")
    distinct = stage(prints.groupBy("bits").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_same")),
                     "simhash-distinct")
    labels = component_labels(fingerprint_links(distinct.select("bits")))
    known = distinct.join(labels.select(F.col("node").alias("bits"), "label"), "bits", "left").select(
        "bits", "first_id", "n_same", F.coalesce("label", "bits").alias("label"))
    smallest = known.groupBy("label").agg(F.min("first_id").alias("component_id"))
    placed = known.join(smallest, "label").select("bits", "component_id", "n_same", "label")
    return prints.join(placed, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id", "n_same", "print", "label")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of each component, all columns kept.

    Rows that repeat the kept id are reduced to one; where no id is known, one
    row of the component stays. Only ids and fingerprints are shuffled: repeated
    rows, which are few, are the only texts that are grouped.
    """
    names = [F.col(f"`{n}`") for n in docs.columns]
    found = stage(near_duplicates(docs), "simhash-components")
    # The smallest (id, print) of a component names its document; unknown ids come last.
    row = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "print")
    first = found.groupBy("fingerprint", "component_id").agg(F.min(row).alias("row"), F.min("label").alias("label"))
    chosen = stage(first.groupBy("label").agg(F.min("row").alias("row")).select(
        F.col("row.doc_id").alias("_llm_id"), F.col("row.print").alias("_llm_print")), "simhash-chosen")
    often = found.groupBy("doc_id", "print").count().filter("count > 1").select(
        F.col("doc_id").alias("_llm_id"), F.col("print").alias("_llm_print"))
    often = stage(often.join(chosen, _same(often, chosen), "left_semi"), "simhash-repeated")
    once = stage(chosen.join(often, _same(chosen, often), "left_anti"), "simhash-single")
    keyed = docs.select(*names, F.xxhash64(F.col("text").cast("string")).alias("_llm_text"))

    def rows_of(wanted: DataFrame) -> DataFrame:
        mine = F.col("doc_id").eqNullSafe(F.col("_llm_id")) & (F.col("_llm_text") == F.col("_llm_print"))
        return keyed.join(wanted, mine, "left_semi").select(*names)

    repeated = rows_of(often).dropDuplicates(["doc_id", "text"])
    return rows_of(once).union(repeated)


def _same(a: DataFrame, b: DataFrame):
    return a["_llm_id"].eqNullSafe(b["_llm_id"]) & (a["_llm_print"] == b["_llm_print"])

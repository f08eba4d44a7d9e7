"""Conversation repair: the cheapest edits that make roles alternate, with an audit.

Rows are placed within their conversation by a range sort and cut into blocks of
at most 256; a block with all its rows is one row of a table. For each block the
cheapest edits from every state to every state are found over shared, linked edit
strings (`trails.py`). A conversation of one block is then done; blocks of a longer
one are joined 64 at a time, level by level, so a conversation of any size is
spread over tasks until its one audit is put together. The audit is cut again
into the blocks, which repair their rows and hand on one text each for the hash.

Defined cases: null role, text, turn and conv_id count as one space (a null
conv_id is a conversation of its own); rows without a turn come first; rows of
one turn are ordered by role and text, so repeated rows stand together; roles
count by their first letter, and one that is not s, u or a never stays as it is;
a conversation without rows after damage has zeros, no edits and the hash of
nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.llm import trails
from mapweave.llm.places import ranked
from mapweave.sources.tables import stage

#: Rows of a block, and blocks that are joined at a time.
BLOCK_ROWS = 256
JOINED = 64

_SPACE = r"\x20\x09-\x0D"
_EDITS = "costs array<long>, edits array<string>"


def _key(conv_id: Column) -> Column:
    """Never null; a null id is a key of its own."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def plain(rows: DataFrame, *more: Column) -> DataFrame:
    """(conv, turn, role, text) with nulls of role and text as one space, and more columns."""
    space = F.lit(" ")
    return rows.select(_key(F.col("conv_id")).alias("conv"), F.col("turn"),
                       F.coalesce(F.col("role").cast("string"), space).alias("role"),
                       F.coalesce(F.col("text").cast("string"), space).alias("text"), *more)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text) after the damage that a checksum of id and turn chooses."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                    F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    marked = plain(rows, (F.crc32(name.cast("binary")) % 20).alias("harm"))
    harm = F.col("harm")
    times = F.when(harm == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    text = F.when(harm == 1, "").when(harm == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return marked.filter(harm != 0).select(
        "conv", "turn", F.when(harm == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(times).alias("time")).drop("time")


def with_faults(rows: DataFrame) -> DataFrame:
    """(conv, pos, n, turn, role, text, fault): the first fault of each row, or `-`."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = stage(ranked(rows, "conv", order, "conversation-order"), "conversation-places")
    # The first of equal rows by aggregation, so that a text that fills a conversation is merged before the shuffle.
    firsts = placed.groupBy("conv", "role", "text").agg(F.min("pos").alias("pos")).select(
        "conv", "pos", F.lit(True).alias("first"))
    blank = ~F.col("text").rlike(f"[^{_SPACE}]")
    ends = F.col("text").rlike(rf"[.!?][{_SPACE}]*\z")
    fault = F.when(blank, "b").when(F.col("first").isNull(), "d").when(~ends, "t").otherwise("-")
    return placed.join(firsts, ["conv", "pos"], "left").withColumn("fault", fault).drop("first")


def blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv, block, n, next, codes, roles, texts): the rows of a block in order, and the initial after it."""
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("-")
    block = F.floor(F.col("pos") / block_rows)
    # The first row of a block also shows its initial to the block before.
    at = F.when((F.col("pos") > 0) & (F.col("pos") % block_rows == 0), F.array(block, block - 1)).otherwise(F.array(block))
    shown = rows.select("conv", "pos", "n", initial.alias("initial"), "fault", "role", "text", F.explode(at).alias("block"))
    own = F.col("pos") < (F.col("block") + 1) * block_rows
    row = F.struct("pos", F.concat("initial", "fault").alias("code"), "role", "text")
    listed = shown.groupBy("conv", "block").agg(
        F.sort_array(F.collect_list(F.when(own, row))).alias("rows"), F.max(F.when(~own, F.col("initial"))).alias("next"),
        F.first("n").alias("n"))
    return listed.select("conv", "block", "n", "next", F.array_join(F.col("rows.code"), "").alias("codes"),
                         F.col("rows.role").alias("roles"), F.col("rows.text").alias("texts"))


def _edit_columns(found: list[list]) -> list[pa.Array]:
    costs = [[e and e[0] for e in edits] for edits in found]
    texts = [[e and e[1] for e in edits] for edits in found]
    return [pa.array(costs, pa.list_(pa.int64())), pa.array(texts, pa.list_(pa.string()))]


def _edit_lists(costs: pa.Array, texts: pa.Array) -> list[list]:
    return [[None if c is None else (c, t) for c, t in zip(*pair)] for pair in zip(costs.to_pylist(), texts.to_pylist())]


def _block_edits(block_rows: int):
    legal = {"su", "ua", "au"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, illegal = [], []
            for block, n, after, codes in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                last = (block + 1) * block_rows >= n
                sources = range(trails.STATES) if block else range(1)
                found.append(trails.block_edits(codes, sources, last))
                roles = codes[::2] + (after or "")
                illegal.append(sum(roles[i:i + 2] not in legal for i in range(len(roles) - 1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(illegal, pa.int64()), *_edit_columns(found)],
                names=["conv", "block", "n", "illegal", "costs", "edits"])

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for parts in batch.column(2).to_pylist():
            found.append(trails.joined_edits([
                [None if c is None else (c, t) for c, t in zip(p["costs"], p["edits"])] for p in parts]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_edit_columns(found)],
                                         names=["conv", "block", "costs", "edits"])


def _audits(block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, block, cost, edits, state = [], [], [], [], []
            for key, found in zip(batch.column(0).to_pylist(), _edit_lists(batch.column(1), batch.column(2))):
                total, audit = trails.cheapest(found)
                for i, (part, before) in enumerate(trails.cut(audit, block_rows)):
                    conv.append(key)
                    block.append(i)
                    cost.append(0 if i else total)
                    edits.append(part)
                    state.append(before)
            yield pa.RecordBatch.from_arrays(
                [pa.array(conv, pa.string()), pa.array(block, pa.int64()), pa.array(cost, pa.int64()),
                 pa.array(edits, pa.string()), pa.array(state, pa.int64())],
                names=["conv", "block", "cost", "edits", "state"])

    return run


def audits(cut_rows: DataFrame, block_rows: int = BLOCK_ROWS, joined: int = JOINED) -> tuple[DataFrame, DataFrame]:
    """(conv, block, cost, edits, state) of every block, and (conv, block, illegal)."""
    found = stage(cut_rows.select("conv", "block", "n", "next", "codes").mapInArrow(
        _block_edits(block_rows), f"conv string, block long, n long, illegal long, {_EDITS}"), "conversation-edits")
    whole = found.filter(F.col("n") <= block_rows).select("conv", "costs", "edits")
    parts = found.filter(F.col("n") > block_rows).select("conv", "block", "costs", "edits")
    most = -(-(found.agg(F.max("n")).first()[0] or 0) // block_rows)
    while most > 1:
        group = F.floor(F.col("block") / joined)
        listed = parts.groupBy("conv", group.alias("group")).agg(
            F.sort_array(F.collect_list(F.struct("block", "costs", "edits"))).alias("parts"))
        parts = stage(listed.mapInArrow(_joined, f"conv string, block long, {_EDITS}"), "conversation-joined")
        most = -(-most // joined)
    every = whole.union(parts.select("conv", "costs", "edits"))
    cut_up = every.mapInArrow(_audits(block_rows), "conv string, block long, cost long, edits string, state long")
    return stage(cut_up, "conversation-audits"), found.select("conv", "block", "illegal")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [trails.repaired(*row) for row in zip(*(batch.column(i).to_pylist() for i in range(2, 6)))]
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        rows = pa.array([[{"role": r, "text": t} for r, t in rows] for rows in lists], kind)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), rows],
                                         names=["conv", "block", "edits", "rows"])


def repaired_blocks(cut_rows: DataFrame, audit: DataFrame) -> DataFrame:
    """(conv, block, edits, rows): the repaired rows of each block, in order."""
    put = cut_rows.select("conv", "block", "roles", "texts").join(audit.select("conv", "block", "edits", "state"), ["conv", "block"])
    return put.select("conv", "block", "edits", "state", "roles", "texts").mapInArrow(
        _repaired, "conv string, block long, edits string, rows array<struct<role: string, text: string>>")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from its blocks in order; the hash goes on from block to block."""
    conv, parts, digest, written = None, [], None, False

    def row():
        return pa.RecordBatch.from_pydict({"conv": [conv], "audit": ["".join(parts).replace(trails.KEEP_SYSTEM, trails.KEEP)],
                                           "repaired_sha256": [digest.hexdigest()]})

    for batch in batches:
        done = []
        for key, edits, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
            if key != conv or digest is None:
                if digest is not None:
                    done.append(row())
                conv, parts, digest, written = key, [], hashlib.sha256(), False
            parts.append(edits)
            if text:  # a repaired row holds a colon at least
                digest.update((b"\n" if written else b"") + text.encode())
                written = True
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if digest is not None:
        yield row()


def repair(conversations: DataFrame, damage: bool = False, block_rows: int = BLOCK_ROWS,
           joined: int = JOINED) -> tuple[DataFrame, DataFrame]:
    """A report of each conversation, and the repaired rows of its blocks (conv, block, edits, rows)."""
    rows = with_faults(damaged(conversations) if damage else plain(conversations))
    rows = stage(rows, "conversation-rows")
    cut_rows = stage(blocks(rows, block_rows), "conversation-blocks")
    audit, pairs = audits(cut_rows, block_rows, joined)
    fixed = stage(repaired_blocks(cut_rows, audit), "conversation-repaired")
    lines = F.array_join(F.transform("rows", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    ordered = fixed.select("conv", "block", "edits", lines.alias("text")).repartition("conv").sortWithinPartitions("conv", "block")
    hashes = ordered.mapInArrow(_digests, "conv string, audit string, repaired_sha256 string")
    turn = F.col("turn").cast("long")
    gaps = F.coalesce(F.max(turn) - F.min(turn) + 1 - F.countDistinct(turn), F.lit(0))
    faults = {name: F.sum((F.col("fault") == name[0]).cast("long")).alias(name) for name in ("blank", "duplicate", "truncated")}
    counts = rows.groupBy("conv").agg(gaps.alias("gaps"), *faults.values())
    costs = audit.groupBy("conv").agg(F.sum("cost").alias("cost"))
    illegal = pairs.groupBy("conv").agg(F.sum("illegal").alias("illegal"))
    ids = conversations.select("conv_id", _key(F.col("conv_id")).alias("conv")).distinct()
    found = ids.join(counts, "conv", "left").join(illegal, "conv", "left").join(costs, "conv", "left").join(hashes, "conv", "left")
    numbers = [F.coalesce(name, F.lit(0)).cast("long").alias(name)
               for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")), fixed

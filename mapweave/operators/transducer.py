"""Delimited text as a finite-state transducer over lines, run block by block.

At a line end the parser of a delimited file is in one of two states: between
records, or inside a quoted cell. A line is a function of the two, and so is any
run of lines; functions are joined by running sums within a chunk of lines and
then over one row for each chunk. With the state before each line known, every
line is parsed where it lies: no task reads a whole file.

A function is told by where it leaves off from either state: lines without
quotes keep the state, lines with one open quote may swap it, others settle it.
The state before a line is that of the last settling line before it, swapped as
often as lines have swapped since.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from mapweave.operators import dialect as L
from mapweave.sources.blocks import CHUNK, chunk_runs, running, whole_runs, with_file
from mapweave.sources.tables import drop_staged, stage

#: Rounds in which the texts of all files are put together.
ROUNDS = 4

_PLACE = [*CHUNK, "id"]
#: Problems in order: the first that a file has is shown.
_PROBLEMS = ("unexpected end of data in a quoted cell", "text after a closing quote", "new-line character in an unquoted cell")
# The rest of a quoted cell that began on an earlier line, with its closing quote.
_CLOSING = r'^[^"]*+(?:""[^"]*+)*+"'
# A carriage return that is not part of the line end.
_RETURN = r"\r(?!\r|\z)"


def _count(text: Column, part: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))


def _from_between(text: Column, d: str) -> Column:
    """What a line does from between two records: (quoted at its end, delimiters outside quotes, problem)."""
    def of(masked: Column) -> Column:
        opening = F.regexp_extract(masked, rf"^((?s:.*?)){L.opening_quote(d)}", 0)
        open_ = opening != ""
        head = F.when(open_, F.substring(opening, F.lit(1), F.length(opening) - 1)).otherwise(masked)
        return F.struct(open_.cast("int").alias("quoted"), _count(head, d).alias("n"), F.when(
            head.contains(L.QUOTED) & head.rlike(rf"{L.QUOTED}[^{L.escaped(d)}\r\n]"), 1).when(
            head.contains("\r") & F.concat(head, F.when(open_, '"').otherwise("")).rlike(_RETURN), 2).otherwise(0).alias("problem"))

    return L.once(L.masked(text, d), of)


def _line(text: Column, d: str) -> Column:
    """What a line does from both states."""
    rest = F.regexp_extract(text, _CLOSING, 0)
    closed = F.concat(F.lit(L.QUOTED), F.substring(text, F.length(rest) + 1, F.lit(2**31 - 1)))
    still = F.struct(F.lit(1).alias("quoted"), F.lit(0).alias("n"), F.lit(0).alias("problem"))
    inside = F.when(rest == "", still).otherwise(_from_between(closed, d))
    plain = F.struct(F.lit(0).alias("quoted"), _count(text, d).alias("n"),
                     F.when(text.contains("\r") & text.rlike(_RETURN), 2).otherwise(0).alias("problem"))
    return F.when(text.contains('"'), F.struct(_from_between(text, d).alias("out"), inside.alias("in"))).otherwise(
        F.struct(plain.alias("out"), still.alias("in")))


def _swapped(state: Column, times: Column) -> Column:
    return state.bitwiseXOR(times.bitwiseAND(1))


def _state_before(settles: Column, state: Column, swaps: Column, window, start: Column) -> Column:
    """State before a row from those before it in the window: ``start`` unless one of them settles it."""
    so_far = F.sum(swaps).over(window.rowsBetween(W.unboundedPreceding, 0))
    mark = F.when(settles, F.struct(state.alias("state"), so_far.alias("swaps")))
    last = F.last(mark, ignorenulls=True).over(window.rowsBetween(W.unboundedPreceding, -1))
    times = F.coalesce(F.sum(swaps).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return F.when(last.isNotNull(), _swapped(last["state"], times - last["swaps"])).otherwise(_swapped(start, times))


def line_functions(lines: DataFrame, delimiters: Sequence[str]) -> DataFrame:
    """``lines`` with w0, w1, ...: what each line does from both states, for each delimiter."""
    return lines.withColumns({f"w{i}": _line(F.col("text"), d) for i, d in enumerate(delimiters)})


def with_states(told: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``told``, in each field what a line does from the state before it.

    A field holds ``entry`` (1 inside a quoted cell), ``quoted`` at the end of
    the line, the delimiters ``n`` outside quotes and the ``problem``.
    """
    inside, across = W.partitionBy(*CHUNK).orderBy("id"), W.partitionBy("file_id").orderBy("block", "chunk")
    local, after, entries, columns = {}, [], {}, []
    for f in fields:
        out, in_ = F.col(f"{f}.out.quoted"), F.col(f"{f}.in.quoted")
        swaps = ((out == 1) & (in_ == 0)).cast("long")
        for s in (0, 1):
            # The state before a line, and behind its chunk, from either state before the chunk.
            local[f"{f}_{s}"] = _state_before(out == in_, out.cast("long"), swaps, inside, F.lit(s).cast("long"))
            left = F.when(F.col(f"{f}_{s}") == 1, in_).otherwise(out).cast("long")
            after.append(F.max_by(left, F.col("id")).alias(f"{f}_{s}"))
        zero, one = F.col(f"{f}_0"), F.col(f"{f}_1")
        entries[f"{f}_at"] = _state_before(
            zero == one, zero, ((zero == 1) & (one == 0)).cast("long"), across, F.lit(0).cast("long"))
        entry = F.when(F.col(f"{f}_at") == 1, F.col(f"{f}_1")).otherwise(F.col(f"{f}_0"))
        does = F.when(entry == 1, F.col(f"{f}.in")).otherwise(F.col(f"{f}.out"))
        columns.append(F.struct(entry.cast("int").alias("entry"), does["quoted"].alias("quoted"), does["n"].alias("n"),
                                does["problem"].alias("problem")).alias(f))
    placed = told.withColumns(local)
    chunks = placed.groupBy(*CHUNK).agg(*after).withColumns(entries).select(*CHUNK, *entries)
    others = [c for c in told.columns if c not in (*_PLACE, *fields)]
    return placed.join(chunks, CHUNK).select(*_PLACE, *others, *columns)


def _problem(lines: DataFrame, field: str) -> DataFrame:
    """(file_id, problem, multi_line) of each file with lines in one delimiter; the problem is null if there is none."""
    last = F.max_by(F.col(f"{field}.quoted"), F.struct("block", "id"))
    found = F.min(F.when(F.col(f"{field}.problem") > 0, F.col(f"{field}.problem")))
    broken = F.some((F.col(f"{field}.entry") == 1) | (F.col(f"{field}.quoted") == 1)).alias("multi_line")
    return lines.groupBy("file_id").agg(last.alias("last"), found.alias("found"), broken).select(
        "file_id", "multi_line", F.when(F.col("last") == 1, _PROBLEMS[0]).when(F.col("found") == 1, _PROBLEMS[1])
        .when(F.col("found") == 2, _PROBLEMS[2]).alias("problem"))


def numbered_records(lines: DataFrame, field: str) -> DataFrame:
    """``lines`` with ``record``, the number of the record in the file that a line belongs to."""
    return running(lines, F.col(f"{field}.entry") == 0, "record", own=True)


def _widths(lines: DataFrame, field: str, rank: int) -> DataFrame:
    """(file_id, width, n, rank): how many records of each width above 1 a file has in one delimiter."""
    one_line = (F.col(f"{field}.entry") == 0) & (F.col(f"{field}.quoted") == 0)
    single = lines.where(one_line).select("file_id", (F.col(f"{field}.n") + 1).alias("width"))
    # Only records of several lines are put together; they are numbered among themselves.
    several = numbered_records(lines.where(~one_line).select(*CHUNK, "id", field), field).groupBy("file_id", "record").agg(
        (F.sum(f"{field}.n") + 1).alias("width"))
    return single.union(several.select("file_id", "width")).where("width > 1").groupBy("file_id", "width").agg(
        F.count("*").alias("n"), F.lit(-rank).alias("rank"))


def delimiters(lines: DataFrame, fields: list[str]) -> DataFrame:
    """(file_id, rank, n): the delimiter (by rank) with the most records of one width, and its problem-free files only."""
    scored = [_widths(lines, f, i).join(_problem(lines, f).where("problem IS NULL").select("file_id"), "file_id")
              for i, f in enumerate(fields)]
    best = F.max(F.struct("n", "width", "rank"))
    return reduce(DataFrame.union, scored).groupBy("file_id").agg((-best["rank"]).alias("rank"))


def record_cells(lines: DataFrame, field: str, delimiter: Column) -> DataFrame:
    """(file_id, row_idx, cells, broken): the records of files; ``broken`` if a cell has a line break.

    ``lines`` may have a ``delimiter`` column for ``delimiter`` to name.
    """
    return _cells(_chunk_records(numbered_records(lines.withColumn("_d", delimiter), field), field))


def _chunk_records(numbered: DataFrame, field: str) -> DataFrame:
    """Lines of records, put together in their chunk."""
    entry, quoted = F.col(f"{field}.entry"), F.col(f"{field}.quoted")
    ended = F.when(quoted == 0, F.regexp_replace("text", r"\r+$", "")).otherwise(F.col("text"))
    part = F.struct("block", "id", ended.alias("text"), ((entry == 0) & (quoted == 0)).alias("whole"))
    return chunk_runs(numbered.select(*_PLACE, "record", "_d", part.alias("_part")), "record", ["_d"], F.col("_part"))


def _cells(runs: DataFrame) -> DataFrame:
    """(file_id, row_idx, cells, broken) of records that are put together in their chunks."""
    text, broken = F.array_join(F.col("_parts.text"), "\n"), ~F.col("_parts")[0]["whole"]
    found = whole_runs(runs, "record", ["_d"]).select(
        "file_id", F.col("record").alias("row_idx"), text.alias("_text"), "_d", broken.alias("broken"))
    return found.select("file_id", "row_idx", L.cells(F.col("_text"), F.col("_d")).alias("cells"), "broken")


def _chunk_starts(states: DataFrame) -> DataFrame:
    """(file_id, block, chunk, _at, _before): the state before a chunk and the number of records that begin before it."""
    numbered = numbered_records(states, "w")
    first = F.min_by(F.struct(F.col("w.entry").alias("entry"), "record"), "id")
    return numbered.groupBy(*CHUNK).agg(first.alias("_first")).select(
        *CHUNK, F.col("_first.entry").cast("long").alias("_at"),
        (F.col("_first.record") - (F.col("_first.entry") == 0).cast("long")).alias("_before"))


def _from_starts(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """``lines`` (text, w) with what each line does from the state before it as ``w``, and ``record``."""
    inside = W.partitionBy(*CHUNK).orderBy("id")
    out, in_ = F.col("w.out.quoted"), F.col("w.in.quoted")
    entry = _state_before(out == in_, out.cast("long"), ((out == 1) & (in_ == 0)).cast("long"), inside, F.col("_at"))
    placed = lines.join(starts, CHUNK).withColumn("_entry", entry)
    quoted = F.when(F.col("_entry") == 1, in_).otherwise(out)
    begun = F.sum((F.col("_entry") == 0).cast("long")).over(inside.rowsBetween(W.unboundedPreceding, 0))
    return placed.withColumn("record", F.col("_before") + begun).withColumn(
        "w", F.struct(F.col("_entry").alias("entry"), quoted.alias("quoted")))


def block_grid(files: DataFrame, lines: DataFrame, last: bool = False) -> DataFrame:
    """Cell grid with the dialect of each file, as `dialect.csv_grid` gives it, from lines of text.

    ``files``: file_id, encoding, newline; ``lines``: file_id, block, chunk, id, text.
    The dialect is told from the functions of lines alone. Texts are put together
    once it is known, a few chunks in each round, and what a round has read is
    deleted behind it. ``last``: so is what ``lines`` was staged from, if ``files``
    does not read it.
    """
    fields = [f"w{i}" for i in range(len(L.DELIMITERS))]
    in_round = F.pmod(F.hash(*CHUNK), F.lit(ROUNDS))
    rounds = [stage(line_functions(lines.where(in_round == i), L.DELIMITERS), "line-functions", compact=True) for i in range(ROUNDS)]
    if last:
        drop_staged(lines, files)
    functions = reduce(DataFrame.union, rounds).drop("text")
    told = stage(with_states(functions, fields), "line-states", compact=True)
    chosen = files.select("file_id", "encoding", "newline").join(delimiters(told, fields), "file_id", "left")
    code = F.coalesce("rank", F.lit(0))
    # A file without a delimiter is judged as one with commas.
    problems = reduce(DataFrame.union, [
        _problem(told, f).select("file_id", F.lit(i).alias("_rank"), "problem", "multi_line") for i, f in enumerate(fields)])
    about = stage(chosen.withColumn("_rank", code).join(problems, ["file_id", "_rank"], "left").select(
        "file_id", "encoding", F.element_at(F.array(*[F.lit(d) for d in L.DELIMITERS]), F.col("_rank") + 1).alias("delimiter"),
        "newline", F.col("rank").isNull().alias("fallback"),
        F.when(F.col("encoding").isNull(), "encoding could not be detected").otherwise(F.col("problem")).alias("problem"),
        F.col("multi_line").alias("_broken"), "_rank"), "dialects", compact=True)
    sound = F.col("problem").isNull()
    chosen = about.where(sound).select("file_id", F.col("delimiter").alias("_d"), "_rank")
    function = reduce(lambda acc, i: acc.when(F.col("_rank") == i, F.col(fields[i])), range(1, len(fields)),
                      F.when(F.col("_rank") == 0, F.col(fields[0])))
    starts = stage(_chunk_starts(with_file(told, chosen).select(*_PLACE, function.alias("w"))), "chunk-starts", compact=True)
    drop_staged(told, about)
    runs = []
    for part in rounds:
        parsed = with_file(part, chosen).select(*_PLACE, "text", "_d", function.alias("w"))
        runs.append(stage(_chunk_records(_from_starts(parsed, starts), "w"), "records", compact=True))
        drop_staged(part)
    cells = _cells(reduce(DataFrame.union, runs)).select("file_id", "row_idx", "cells")
    without = about.where(~sound | F.col("_broken").isNull())
    about = about.withColumn("multi_line", sound & F.coalesce("_broken", F.lit(False)))
    empty = F.array().cast("array<string>")
    rows = with_file(cells, about).unionByName(
        without.withColumn("multi_line", F.lit(False)), allowMissingColumns=True)
    first = F.when(sound, F.coalesce("row_idx", F.lit(1)))
    return rows.select("file_id", "encoding", "delimiter", "newline", "fallback", "problem", "multi_line",
                       first.cast("bigint").alias("row_idx"), F.coalesce("cells", empty).alias("cells"))

"""Table discovery on cell grids.

A grid row is (keys..., row_idx, cells ARRAY<STRING>[, types ARRAY<STRING>]);
``keys`` name a file and sheet. Rows of one sheet may be most of the data, so
every step aggregates map-side, ranks with a limit, or works on row ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from mapweave.functions.scalar import PYTHON_SPACE, normalize_name
from mapweave.functions.text import nfkc
from mapweave.operators.ordered import islands, join_by_range, running_count

# Rows that can be a header, and rows below one that speak for it.
HEADER_CANDIDATES = 10
HEADER_LOOKAHEAD = 5
LISTED_ROWS = 20


def filled(cell: Column) -> Column:
    return cell.isNotNull() & (cell != "")


def stripped(cell: Column) -> Column:
    return F.btrim(cell, F.lit(PYTHON_SPACE))


def has_text(cells: Column) -> Column:
    """True where a row has a cell with more than white space."""
    return F.exists(cells, lambda c: c.isNotNull() & (stripped(c) != ""))


def populated(cells: Column) -> Column:
    """True where a row has a cell that is neither null nor empty."""
    return F.exists(cells, filled)


def pad(cells: Column, width: Column | int) -> Column:
    """Cut or pad a row to a width."""
    n = F.lit(width) if isinstance(width, int) else width
    return F.slice(F.concat(cells, F.array_repeat(F.lit(None).cast("string"), n)), F.lit(1), n)


def normalized_headers(headers: DataFrame, keys: list[str]) -> DataFrame:
    """Normalised, unique column names of header tables.

    ``headers``: keys, ordinal (1-based), header. The k-th repeat of a name in
    a table gets ``_k`` and a warning.
    """
    name = normalize_name(nfkc(F.coalesce("header", F.lit(""))), F.col("ordinal"))
    named = headers.withColumn("_name", name)
    counted = running_count(named, [*keys, "_name"], "ordinal", "_k")
    original = stripped(F.coalesce("header", F.lit("")))
    again = F.col("_k") > 1
    return counted.select(
        *keys, "ordinal",
        F.when(original == "", F.concat(F.lit("Column "), F.col("ordinal").cast("string"))).otherwise(original)
        .alias("original_name"),
        F.when(again, F.concat_ws("_", "_name", "_k")).otherwise(F.col("_name")).alias("normalized_name"),
        F.when(again, F.concat(F.lit("Duplicate column name '"), F.coalesce(F.nullif(original, F.lit("")), "_name"),
                               F.lit("' was renamed."))).alias("warning"))


def _widths(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per table and width: all, and those with text (with the first of them)."""
    text = has_text("cells")
    return (grid.where(F.size("cells") > 0).groupBy(*keys, F.size("cells").alias("w"))
            .agg(F.count("*").alias("n_all"), F.count_if(text).alias("n"), F.min(F.when(text, F.col("row_idx"))).alias("seen")))


def _modal(widths: DataFrame, keys: list[str]) -> DataFrame:
    return (widths.where("n > 0").groupBy(*keys)
            .agg(F.max_by("w", F.struct("n", -F.col("seen"))).alias("width")))


def modal_width(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Most common width of the populated rows; ties go to the width seen first."""
    return _modal(_widths(grid, keys), keys)


def ragged_rows(grid: DataFrame, keys: list[str], listed: int = LISTED_ROWS) -> DataFrame:
    """Tables with rows of another width: how many, and the first ``listed`` as examples.

    All of them are in ``ragged_row_numbers``.

    Counts come from the rows per width, and the first rows of every width are
    kept by a rank limit that prunes before the shuffle; no row is joined.
    """
    widths = _widths(grid, keys)
    odd = widths.join(_modal(widths, keys), keys).where("w <> width")
    counts = odd.groupBy(*keys, "width").agg(F.sum("n_all").alias("ragged"))

    def first(rows: DataFrame, *by: str) -> DataFrame:
        rank = F.row_number().over(W.partitionBy(*by).orderBy("row_idx"))
        return rows.withColumn("_r", rank).where(F.col("_r") <= listed).drop("_r")

    by_width = first(grid.where(F.size("cells") > 0).select(*keys, F.size("cells").alias("w"), "row_idx"), *keys, "w")
    rows = (first(by_width.join(odd.select(*keys, "w"), [*keys, "w"], "left_semi"), *keys)
            .groupBy(*keys).agg(F.array_sort(F.collect_list("row_idx")).alias("rows")))
    return counts.join(rows, keys)


def ragged_row_numbers(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of another width than its table's: (keys, row_idx, row_width, width)."""
    sized = grid.select(*keys, "row_idx", F.size("cells").cast("bigint").alias("row_width"))
    return join_by_range(sized, modal_width(grid, keys), keys, "row_idx").where("row_width <> width")


def row_score(cells: Column, following: Column, types: Column | None = None) -> Column:
    """How much a row looks like a header, given the widest of the next rows."""
    present = F.filter(cells, filled)
    n = F.size(present)
    text = F.lit(1.0)
    if types is not None:
        kinds = F.filter(F.zip_with(cells, types, lambda c, k: F.when(filled(c), k)), lambda k: k.isNotNull())
        text = F.size(F.filter(kinds, lambda k: k == "str")) / n
    unique = F.size(F.array_distinct(present)) / n
    width = F.least(F.lit(1.0), n / F.greatest(F.lit(1), F.coalesce(following, F.lit(0))))
    return F.when(n == 0, F.lit(-1.0)).otherwise(0.5 * text + 0.3 * unique + 0.2 * width)


def header_rows(grid: DataFrame, keys: list[str], pos: str, candidates: int = HEADER_CANDIDATES,
                lookahead: int = HEADER_LOOKAHEAD) -> DataFrame:
    """Best header candidate of each table: of the first ``candidates`` rows, by the ``lookahead`` rows below each.

    ``pos`` is the 0-based place of a row in its table. Only so many first
    places take part, so a table of any length costs few rows here.
    """
    near = grid.where(F.col(pos) < candidates + lookahead)
    types = F.col("types") if "types" in grid.columns else None
    following = F.max(F.size(F.filter("cells", filled))).over(
        W.partitionBy(*keys).orderBy(pos).rangeBetween(1, lookahead))
    scored = near.withColumn("score", row_score(F.col("cells"), following, types)).where(F.col(pos) < candidates)
    best = F.max_by(F.struct(F.col(pos).alias("header_pos"), F.col("row_idx").alias("header_row"), "score",
                             F.col("cells").alias("header")), F.struct("score", -F.col(pos)))
    return scored.groupBy(*keys).agg(best.alias("_h")).select(*keys, "_h.*")


def data_rows(grid: DataFrame, headers: DataFrame, keys: list[str], pos: str, keep_blank: bool = False) -> DataFrame:
    """Rows below the header without repeats of it and, by default, blank rows."""
    below = join_by_range(grid, headers.select(*keys, "header_pos", "header"), keys, "row_idx").where(F.col(pos) > F.col("header_pos"))
    kept = below.where(~F.col("cells").eqNullSafe(F.col("header"))).drop("header", "header_pos")
    return kept if keep_blank else kept.where(populated("cells"))


def dropped_rows(grid: DataFrame, headers: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Preamble, blank and repeated-header rows of each table."""
    joined = join_by_range(grid, headers.select(*keys, "header_pos", "header"), keys, "row_idx")
    below = F.col(pos) > F.col("header_pos")
    return joined.groupBy(*keys).agg(
        F.first("header_pos").alias("preamble"),
        F.count_if(below & ~populated("cells")).alias("blank"),
        F.count_if(below & F.col("cells").eqNullSafe(F.col("header"))).alias("repeated"))


def with_regions(grid: DataFrame, keys: list[str], **options) -> DataFrame:
    """Populated rows with the number of their region; two blank rows end one."""
    return islands(grid.where(populated("cells")), keys, "row_idx", 2, "region", **options)


def regions(numbered: DataFrame, keys: list[str]) -> DataFrame:
    """Bounds of each region; one row with one column is only a title."""
    at = F.transform("cells", lambda c, i: F.when(filled(c), i + 1))
    bounds = numbered.withColumns({"_min": F.array_min(at), "_max": F.array_max(at)})
    return bounds.groupBy(*keys, "region").agg(
        F.min("row_idx").alias("min_row"), F.max("row_idx").alias("max_row"),
        F.min("_min").alias("min_col"), F.max("_max").alias("max_col")).withColumn(
        "is_title", (F.col("min_row") == F.col("max_row")) & (F.col("min_col") == F.col("max_col")))


def region_cells(numbered: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the real tables, cut to their columns, with their place in the table."""
    tables = bounds.where("NOT is_title")
    width = F.col("max_col") - F.col("min_col") + 1
    rest = [c for c in numbered.columns if c not in (*keys, "region", "cells", "types")]
    cut = {"cells": pad(F.slice("cells", F.col("min_col"), width), width)}
    if "types" in numbered.columns:
        cut["types"] = pad(F.slice("types", F.col("min_col"), width), width)
    return (join_by_range(numbered, tables, [*keys, "region"], "row_idx")
            .select(*keys, "region", *rest, *[c.alias(n) for n, c in cut.items()],
                    (F.col("row_idx") - F.col("min_row")).alias("pos")))


def column_letter(index: Column) -> Column:
    """Worksheet letters of a 1-based column number (A to ZZZ)."""
    def digit(n: Column) -> Column:
        return F.char(F.lit(65) + n)

    n = index - 1
    two = F.floor((n - 26) / 26)
    three = F.floor((n - 702) / 676)
    return (F.when(n < 26, digit(n)).when(n < 702, F.concat(digit(two % 26), digit(n % 26)))
            .otherwise(F.concat(digit(three), digit(F.floor((n - 702) / 26) % 26), digit(n % 26))))


def cell_range(min_col: Column, min_row: Column, max_col: Column, max_row: Column) -> Column:
    """A1-style name of a rectangle."""
    return F.concat(column_letter(min_col), min_row.cast("string"), F.lit(":"),
                    column_letter(max_col), max_row.cast("string"))


_RADIX_BITS = 2


def _level() -> Column:
    """The smallest block size that a rectangle's row range fits into."""
    length = F.col("max_row").cast("bigint") - F.col("min_row").cast("bigint") + 1
    return F.when(length <= 1, 0).otherwise(F.shiftright(F.length(F.bin(length - 1)) + _RADIX_BITS - 1, 1))


def _levels(df: DataFrame) -> list[int]:
    """Block sizes of the rectangles of a table."""
    seen = df.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), _level()))).head()[0] or 0
    return [v for v in range(seen.bit_length()) if seen >> v & 1]


def _block_of(row: Column, level: int) -> Column:
    return F.shiftright(row.cast("bigint"), _RADIX_BITS * level)


def overlaps(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of rectangles of one sheet that share a cell.

    Both sides: keys, min_row, max_row, min_col, max_col (rows from 0) and an
    id (``left_id``, ``right_id``). Blocks of rows have sizes in steps of four. Of two
    rectangles the longer one (the left one, if alike) stands once, in the block of
    its own size that it starts in; the other one is copied to each block of that
    size where a range that meets it can start, three at most. So every pair
    meets once in an equi join, a long range makes no more copies than a short one,
    and rows meet only within a few lengths of the longer one.
    """
    fields = ["min_row", "max_row", "min_col", "max_col"]
    left_levels, right_levels = _levels(left), _levels(right)

    def named(df: DataFrame, prefix: str) -> DataFrame:
        return df.withColumn("_level", _level()).select(
            *keys, f"{prefix}_id", "_level", *[F.col(c).alias(f"{prefix}_{c}") for c in fields])

    def starts(df: DataFrame, prefix: str) -> DataFrame:
        row = F.col(f"{prefix}_min_row").cast("bigint")
        return df.withColumn("_block", F.call_function("shiftright", row, F.col("_level") * _RADIX_BITS))

    def copies(df: DataFrame, prefix: str, levels: list[int], least: Column) -> DataFrame:
        first, last = F.col(f"{prefix}_min_row").cast("bigint"), F.col(f"{prefix}_max_row").cast("bigint")
        runs = [F.struct(F.lit(v).alias("_at"), _block_of(first - ((1 << (_RADIX_BITS * v)) - 1), v).alias("_start"),
                         _block_of(last, v).alias("_end")) for v in levels]
        placed = df.select("*", F.inline(F.array(*runs))).where((F.col("_at") >= least) & (F.col("_start") <= F.col("_end")))
        return placed.select("*", F.explode(F.sequence("_start", "_end")).alias("_block")).drop("_level", "_start", "_end").withColumnRenamed("_at", "_level")

    on = [*keys, "_level", "_block"]
    a, b = named(left, "left"), named(right, "right")
    meet = F.expr("left_min_row <= right_max_row AND right_min_row <= left_max_row AND left_min_col <= right_max_col AND right_min_col <= left_max_col")
    parts = []
    if left_levels and right_levels and left_levels[-1] >= right_levels[0]:
        parts.append(starts(a, "left").join(copies(b, "right", left_levels, F.col("_level")), on))
    above = [v for v in right_levels if left_levels and v > left_levels[0]]
    if above:
        parts.append(copies(a, "left", above, F.col("_level") + 1).join(starts(b.where(F.col("_level").isin(above)), "right"), on))
    if not parts:
        parts.append(starts(a, "left").join(starts(b, "right"), on).where("false"))
    return reduce(DataFrame.unionByName, [p.where(meet).select(*keys, "left_id", "right_id") for p in parts])


def csv_confidence(warnings: Column) -> Column:
    """Confidence in a delimited table by its number of warnings."""
    return F.when(warnings > 0, F.lit(0.8)).otherwise(F.lit(0.95))


def grid_confidence(score: Column) -> Column:
    """Confidence in a worksheet table by its header score."""
    return F.greatest(F.lit(0.4), F.least(F.lit(0.99), score))


def warning_stream(tables: DataFrame, catalogs: DataFrame) -> DataFrame:
    """Warnings of catalogs and of their tables with the name of their source.

    ``catalogs``: original_filename, warnings. ``tables``: display_name,
    source_table_id, warnings.
    """
    of_catalogs = catalogs.select(
        F.coalesce(F.nullif("original_filename", F.lit("")), F.lit("Source file")).alias("source"), F.inline("warnings"))
    of_tables = tables.select(
        F.coalesce(F.nullif("display_name", F.lit("")), "source_table_id").alias("source"), F.inline("warnings"))
    return of_catalogs.unionByName(of_tables)


def empty_sources(sources: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Sources without one populated row."""
    rows = grid.where(populated("cells")).select(*keys).distinct()
    return sources.join(rows, keys, "left_anti").withColumn("warning", F.lit("contains no table data"))

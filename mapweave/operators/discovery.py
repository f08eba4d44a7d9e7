"""Discovery of delimited files and sheets: one job from raw bytes or grids to a catalog."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from mapweave.functions.ids import column_id, table_id
from mapweave.operators import dialect as L
from mapweave.operators import grid as G
from mapweave.operators import transducer as T
from mapweave.operators.ordered import join_by_range, running_count
from mapweave.sources import blocks as B
from mapweave.sources.tables import stage

_BOOLEAN = r"(?i)^\s*(true|false)\s*$"
_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


@dataclass
class Catalog:
    """``tables`` (one row each), ``columns`` (one row each) and ``warnings``."""

    tables: DataFrame
    columns: DataFrame
    warnings: DataFrame


def column_statistics(rows: DataFrame, keys: list[str], examples: int = 5) -> DataFrame:
    """Statistics per (keys, ordinal) over the cells of data rows.

    The distinct count shuffles on the value too, and examples are ranked with
    a limit, so a table or value with most of the cells makes no hot task.
    """
    cells = rows.select(*keys, "row_idx", F.posexplode("cells").alias("i", "value"))
    value = F.nullif("value", F.lit(""))
    by = [*keys, "i"]
    stats = cells.groupBy(*by).agg(
        F.count("*").alias("n"), F.count(value).alias("present"), F.countDistinct(value).alias("cardinality"),
        F.every(value.rlike(_BOOLEAN)).alias("_b"),
        F.every(value.rlike(_INTEGER) & value.try_cast("bigint").isNotNull()).alias("_i"),
        F.every(value.rlike(_NUMBER)).alias("_d"))
    rank = F.row_number().over(W.partitionBy(*by).orderBy("row_idx"))
    first = (cells.where(value.isNotNull()).withColumn("_r", rank).where(F.col("_r") <= examples).groupBy(*by)
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "value"))), lambda x: x["value"]).alias("examples")))
    n = F.col("n").cast("decimal(20,0)")
    load = F.when(F.col("_b"), "boolean").when(F.col("_i"), "bigint").when(F.col("_d"), "double").otherwise("string")
    return stats.join(first, by, "left").select(
        *keys, (F.col("i") + 1).alias("ordinal"),
        F.when(F.col("present") == 0, "null").otherwise("string").alias("inferred_type"),
        F.when(F.col("present") == 0, "string").otherwise(load).alias("load_type"),
        F.coalesce("examples", F.array().cast("array<string>")).alias("examples"),
        (F.col("n") - F.col("present")).alias("null_count"), ((F.col("n") - F.col("present")) / F.col("n")).alias("null_rate"),
        "cardinality",
        F.bround(F.col("cardinality").cast("decimal(20,0)") / n, 4).cast("double").alias("candidate_key_score"))


def _assemble(tables: DataFrame, headers: DataFrame, data: DataFrame, dropped: DataFrame, keys: list[str],
              sha256: Column, sheet: Column, cell_range: Column, header_number: Column) -> tuple[DataFrame, DataFrame]:
    """Named columns with statistics, and tables with ids and row counts.

    ``headers``: keys and the header cells; ``tables``: keys and whatever
    describes the place of a table.
    """
    cells = headers.select(*keys, F.posexplode("header").alias("i", "header")).select(
        *keys, (F.col("i") + 1).alias("ordinal"), "header")
    names = G.normalized_headers(cells, keys)
    # A header is one row of cells: as wide as a table, however long that is.
    listed = names.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("ordinal", "normalized_name"))), lambda x: x["normalized_name"]).alias("names"))
    counts = data.groupBy(*keys).agg(F.count("*").alias("row_count"))
    tables = (tables.join(listed, keys).join(counts, keys, "left").join(dropped, keys, "left")
              .withColumn("row_count", F.coalesce("row_count", F.lit(0)))
              .withColumn("source_table_id", table_id(sha256, sheet, cell_range, header_number, F.col("names"))))
    tables = stage(tables, "tables")
    # A table without data rows still has its columns.
    nothing = {"inferred_type": F.lit("null"), "load_type": F.lit("string"), "examples": F.array().cast("array<string>"),
               "null_count": F.lit(0), "null_rate": F.lit(0.0), "cardinality": F.lit(0), "candidate_key_score": F.lit(0.0)}
    columns = (names.join(column_statistics(data, keys), [*keys, "ordinal"], "left")
               .withColumns({c: F.coalesce(c, value) for c, value in nothing.items()})
               .join(tables.select(*keys, "source_table_id"), keys)
               .withColumn("source_column_id", column_id(F.col("source_table_id"), F.col("ordinal") - 1, F.col("normalized_name"))))
    return tables, stage(columns, "columns")


def _warning(code: str, when: Column, message: Column) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), message.alias("message")))


def _stream(df: DataFrame, keys: list[str], *warnings: Column) -> DataFrame:
    found = F.filter(F.array(*warnings), lambda w: w.isNotNull())
    return df.select(*keys, F.inline(found))


def discover_delimited(files: DataFrame) -> Catalog:
    """Catalog of delimited files (file_id, content), each read as one table.

    A file that cannot be read gets a warning and no table; it does not stop
    the others. The parsed grid, the placed rows and the headers are staged:
    every file is parsed once.
    """
    return _catalog(stage(L.csv_grid(files), "grid"), files.select("file_id", F.sha2("content", 256).alias("file_sha256")))


def discover_paths(spark: SparkSession, paths: str | Sequence[str]) -> Catalog:
    """Catalog of the delimited files below some paths; the file_id is a file's path.

    Files are read and parsed in blocks by many tasks (`sources.blocks`,
    `operators.transducer`), so one of any size makes no large row. Spark's
    readers list no file without bytes, so such a file is not in the catalog.
    """
    files, lines = stage(B.list_files(spark, paths), "listing"), stage(B.read_bytes(spark, paths), "lines")
    about, text = B.describe(files, lines)
    return _catalog(stage(T.block_grid(about, text), "grid"), stage(B.hash_lines(about, lines), "hashes"))


def _catalog(grid: DataFrame, hashes: DataFrame) -> Catalog:
    """Catalog of parsed files from their staged cell grid and hashes."""
    key = ["file_id"]
    shape = grid.groupBy("file_id", "encoding", "delimiter", "newline", "fallback", "problem", "multi_line").agg(F.count("*").alias("_rows")).drop("_rows")
    rows = grid.where(G.has_text("cells"))
    width = G.modal_width(grid, key)
    padded = (join_by_range(rows, width, key, "row_idx").withColumn("cells", G.pad(F.col("cells"), F.col("width")))
              .select("file_id", "row_idx", "cells"))
    placed = stage(running_count(padded, key, "row_idx", "_n").withColumn("pos", F.col("_n") - 1).drop("_n"), "rows")
    headers = stage(G.header_rows(placed, key, "pos"), "headers")
    data = G.data_rows(placed, headers, key, "pos", keep_blank=True)
    dropped = G.dropped_rows(placed, headers, key, "pos").select("file_id", "repeated")
    ragged = G.ragged_rows(grid, key).select("file_id", "ragged", F.col("rows").alias("ragged_rows"))
    tables = (shape.join(headers, key).join(hashes, key).join(ragged, key, "left"))
    nothing = F.lit("")
    tables, columns = _assemble(tables, headers, data, dropped, key, F.col("file_sha256"), nothing, nothing, F.col("header_pos") + 1)
    noticed = [
        _warning("ragged_rows", F.col("ragged") > 0, F.format_string("Rows of another width than the table: %d", F.col("ragged"))),
        _warning("preamble_detected", F.col("header_pos") > 0, F.format_string("Rows above the header: %d", F.col("header_pos"))),
        _warning("repeated_header", F.col("repeated") > 0, F.format_string("Header rows dropped further down: %d", F.col("repeated"))),
    ]
    flagged = F.size(F.filter(F.array(*noticed), lambda w: w.isNotNull()))
    of_files = _stream(
        shape.join(headers.select("file_id", F.lit(True).alias("_found")), key, "left"), key,
        _warning("malformed", F.col("problem").isNotNull(), F.col("problem")),
        _warning("encoding_fallback", F.col("encoding") == "cp1252", F.lit("Not valid UTF-8; read as Windows-1252")),
        _warning("dialect_fallback", F.col("fallback") & F.col("problem").isNull(), F.lit("No delimiter stands out; comma assumed")),
        _warning("empty_file", F.col("_found").isNull() & F.col("problem").isNull(), F.lit("The file holds no rows")))
    renamed = columns.where("warning IS NOT NULL").select("file_id", F.lit("duplicate_header").alias("code"), F.col("warning").alias("message"))
    warnings = of_files.unionByName(_stream(tables, key, *noticed)).unionByName(renamed)
    return Catalog(tables.withColumn("confidence", G.csv_confidence(flagged)), columns, warnings)


def discover_sheets(grid: DataFrame, hashes: DataFrame, merged: DataFrame | None = None) -> Catalog:
    """Catalog of the tables in cell grids (file_id, sheet, row_idx, cells[, types]).

    ``hashes``: file_id, file_sha256. ``merged``: merged cell rectangles
    (file_id, sheet, min_row, max_row, min_col, max_col, range).
    """
    sheet_keys, keys = ["file_id", "sheet"], ["file_id", "sheet", "region"]
    numbered = stage(G.with_regions(grid, sheet_keys), "regions")
    bounds = stage(G.regions(numbered, sheet_keys), "bounds")
    cells = G.region_cells(numbered, bounds, sheet_keys)
    headers = stage(G.header_rows(cells, keys, "pos"), "headers")
    data = G.data_rows(cells, headers, keys, "pos")
    dropped = G.dropped_rows(cells, headers, keys, "pos").select(*keys, "repeated")
    counted = bounds.groupBy(*sheet_keys).agg(F.count("*").alias("_regions"))
    place = G.cell_range(F.col("min_col"), F.col("header_row"), F.col("max_col"), F.col("max_row"))
    tables = (bounds.where("NOT is_title").join(headers, keys).join(hashes, "file_id").join(counted, sheet_keys)
              .withColumn("cell_range", place)
              .withColumn("display_name", F.when(F.col("_regions") > 1, F.format_string("%s table %d", "sheet", "region")).otherwise(F.col("sheet"))))
    tables, columns = _assemble(tables, headers, data, dropped, keys, F.col("file_sha256"), F.col("sheet"), F.col("cell_range"), F.col("header_row"))
    tables = tables.withColumn("confidence", G.grid_confidence(F.col("score")))
    place_name = F.concat_ws("!", "sheet", "cell_range")
    warnings = _stream(
        tables, keys,
        _warning("preamble_detected", F.col("header_pos") > 0, F.format_string("Rows above the header of %2$s: %1$d", F.col("header_pos"), place_name)),
        _warning("repeated_header", F.col("repeated") > 0, F.format_string("Header rows dropped further down in %2$s: %1$d", F.col("repeated"), place_name)))
    titles = bounds.where("is_title").select(*keys, F.lit("title_row_ignored").alias("code"), F.lit("A lone title row was left out").alias("message"))
    renamed = columns.where("warning IS NOT NULL").select(*keys, F.lit("duplicate_header").alias("code"), F.col("warning").alias("message"))
    blank = G.empty_sources(grid.select(*sheet_keys).distinct(), numbered, sheet_keys).select(
        *sheet_keys, F.lit(None).cast("bigint").alias("region"), F.lit("empty_sheet").alias("code"),
        F.concat_ws(" ", F.lit("Worksheet"), "sheet", "warning").alias("message"))
    warnings = warnings.unionByName(titles).unionByName(renamed).unionByName(blank)
    if merged is not None:
        left = tables.select(*sheet_keys, F.col("region").alias("left_id"), F.col("header_row").alias("min_row"), "max_row", "min_col", "max_col")
        right = merged.withColumnRenamed("range", "right_id")
        hits = G.overlaps(left, right, sheet_keys).select(*sheet_keys, F.col("left_id").alias("region"), F.lit("merged_cells").alias("code"),
                                                          F.concat(F.lit("Merged cells inside the table: "), "right_id").alias("message"))
        warnings = warnings.unionByName(hits)
    return Catalog(tables, columns, warnings)

"""Tabular sources and sinks: CSV, cell grids, JSON contracts and run logs."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from mapweave.functions.scalar import PYTHON_SPACE
from mapweave.operators import transducer as T
from mapweave.operators.grid import has_text
from mapweave.schemas import TARGET_SCHEMA, TargetColumn, TargetTable
from mapweave.sources import blocks as B
from mapweave.sources.files import scan_folder
from mapweave.sources.tables import stage

# Where a target contract is looked for, in this order.
CONTRACT_NAMES = ("target_schema.json", "target-schema.json", "schema.json")


@dataclass(frozen=True)
class CsvLayout:
    """Catalogued location of a delimited table; ``names`` are normalised."""

    names: tuple[str, ...]
    delimiter: str = ","
    quote: str = '"'
    encoding: str = "utf-8"
    header_row: int = 1
    types: tuple[str, ...] = ()
    multi_line: bool = False


def read_delimited(spark: SparkSession, path: str | Sequence[str], layout: CsvLayout) -> DataFrame:
    """Read a delimited table with its catalogued layout, all cells as text first.

    ``header_row`` is the header's line of the file as discovery counts it, blank
    lines included. What stands above it, blank lines and repeats of the header
    are dropped; long rows are cut, short rows padded with nulls, and the
    catalogued load types are applied with casts that give null. Files are read
    in blocks; those with line breaks in cells (``multi_line``) or another
    encoding than UTF-8 are parsed as a transducer over their lines.
    """
    plain = layout.encoding in ("utf-8", "utf-8-sig") and not layout.multi_line
    rows = _lines(spark, path, layout) if plain else _decoded(spark, path, layout)
    names = layout.names
    cells = [F.nullif(F.col("cells")[i], F.lit("")) for i in range(len(names))]
    types = dict(zip(names, layout.types))
    return rows.select(*[(c if types.get(n, "string") == "string" else c.try_cast(types[n])).alias(n)
                         for n, c in zip(names, cells)])


def _lines(spark: SparkSession, path: str | Sequence[str], layout: CsvLayout) -> DataFrame:
    """Cells of the data lines of UTF-8 files, read line by line.

    Line ids grow along a task, and a file's first lines are those of its block
    0, so one small aggregate finds where each file starts and its header. A
    line is parsed once, by a generator, and so is the header of a file.
    """
    lines = spark.read.text(list(path) if not isinstance(path, str) else path).select(
        F.regexp_replace("value", r"\r$", "").alias("_line"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    first = lines.where("_block = 0")
    header = first.groupBy("_file").agg(F.min("_id").alias("_start"), F.min_by("_line", "_id").alias("_header"))
    if layout.header_row > 1:
        header = (first.join(header.drop("_header"), "_file").where(F.col("_id") == F.col("_start") + layout.header_row - 1)
                  .select("_file", "_start", F.col("_line").alias("_header")))
    header = header.withColumn("_header", F.regexp_replace("_header", "^\ufeff", ""))
    below = lines.join(_with_cells(header, "_header", "_h", layout), "_file", "left").where(
        (F.col("_block") > 0) | (F.col("_id") >= F.col("_start") + layout.header_row))
    kept = _with_cells(below, "_line", "cells", layout)
    return kept.where(has_text("cells") & ~F.coalesce(F.col("cells") == F.col("_h"), F.lit(False))).select("cells")


def _with_cells(rows: DataFrame, line: str, out: str, layout: CsvLayout) -> DataFrame:
    """``rows`` with the cells of a line in the width of the layout; missing ones are null."""
    names = [f"_{out}{i}" for i in range(len(layout.names))]
    options = {"sep": layout.delimiter, "quote": layout.quote, "escape": layout.quote, "mode": "PERMISSIVE"}
    parsed = F.from_csv(line, ", ".join(f"{n} string" for n in names), options)
    return rows.select("*", F.inline_outer(F.array(parsed))).withColumn(out, F.array(*names)).drop(*names)


def _decoded(spark: SparkSession, path: str | Sequence[str], layout: CsvLayout) -> DataFrame:
    """Cells of the data records of files in blocks, parsed as discovery does.

    The lines and the records are written, so that each is parsed once.
    """
    text = stage(B.decoded_as(B.read_bytes(spark, path), layout.encoding), "text")
    told = stage(T.with_states(T.line_functions(text, (layout.delimiter,)), ["w0"]), "states")
    grid = stage(T.record_cells(told, "w0", F.lit(layout.delimiter)), "records")
    width = len(layout.names)
    padded = F.slice(F.concat("cells", F.array_repeat(F.lit(None).cast("string"), width)), 1, width)
    rows = grid.select("file_id", "row_idx", padded.alias("cells"))
    header = rows.where(F.col("row_idx") == layout.header_row).select("file_id", F.col("cells").alias("_h"))
    return (rows.where((F.col("row_idx") > layout.header_row) & has_text("cells")).join(header, "file_id", "left")
            .where(~F.coalesce(F.col("cells") == F.col("_h"), F.lit(False))).select("cells"))


def grid_region(grid: DataFrame, names: Sequence[str], headers: Sequence[str | None],
                rows: tuple[int, int], columns: tuple[int, int]) -> DataFrame:
    """Read a rectangle of a cell grid (row_idx, cells) as a named table.

    Rows are cut or padded to the width; the header row, blank rows and
    repeats of the header are dropped.
    """
    width = len(names)
    cut = F.slice(F.concat(F.slice("cells", columns[0], columns[1] - columns[0] + 1),
                           F.array_repeat(F.lit(None).cast("string"), width)), 1, width)
    picked = grid.where(F.col("row_idx").between(rows[0] + 1, rows[1])).select("row_idx", cut.alias("cells"))
    header = F.array(*[F.lit((h or "").strip()) for h in headers])
    plain = F.transform("cells", lambda c: F.coalesce(F.btrim(c, F.lit(PYTHON_SPACE)), F.lit("")))
    kept = picked.where(F.exists("cells", lambda c: c.isNotNull() & (c != "")) & (plain != header))
    return kept.select("row_idx", *[F.col("cells")[i].alias(n) for i, n in enumerate(names)])


def load_sources(spark: SparkSession, layouts: Mapping[str, CsvLayout],
                 paths: Mapping[str, str]) -> dict[str, DataFrame]:
    """Lazy frame per catalogued table id; only delimited text can be loaded."""
    frames = {}
    for table_id, layout in layouts.items():
        path = paths[table_id]
        if PurePosixPath(path).suffix.lower() != ".csv":
            raise ValueError(f"unsupported tabular source for {table_id}: {path}")
        frames[table_id] = read_delimited(spark, path, layout)
    return frames


def load_csv_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Lazy frame per CSV file (or folder of part files) by file stem, when there is no catalog.

    One job finds the header line of every file; the driver gets one row for
    each file, and no further job runs before a frame is used.
    """
    listing = scan_folder(spark, folder).where(F.lower("name").endswith(".csv")).select(F.col("path").alias("_file"), "name")
    lines = spark.read.option("pathGlobFilter", "*.[cC][sS][vV]").text(folder).select(
        F.col("value"), B.file_path().alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    first = lines.where("_block = 0").withColumn("_id", F.monotonically_increasing_id())
    headers = first.groupBy("_file").agg(F.min_by("value", "_id").alias("header"))
    frames = {}
    for row in listing.join(headers, "_file", "left").orderBy("name").toLocalIterator():
        line = (row.header or "").removeprefix("\ufeff").removesuffix("\r")
        names = [n or f"_c{i}" for i, n in enumerate(next(csv.reader([line]), []))]
        schema = StructType([StructField(n, StringType()) for n in names])
        frames[PurePosixPath(row.name).stem] = spark.read.schema(schema).option("header", True).option("escape", '"').csv(row._file)
    return frames


def write_targets(targets: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    """Write each target as CSV under its name; returns the paths by name.

    A single target is also known as ``results``, without a second copy.
    """
    paths = {name: f"{folder.rstrip('/')}/{name}" for name in targets}
    for name, df in targets.items():
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(paths[name])
    if len(paths) == 1:
        paths["results"] = next(iter(paths.values()))
    return paths


def contract_columns(documents: DataFrame) -> DataFrame:
    """Flat target columns of contract documents (column ``tables``)."""
    tables = documents.select(F.explode("tables").alias("t"))
    return tables.select(F.col("t.name").alias("target_table"), F.posexplode("t.columns").alias("pos", "c")).select(
        "target_table", F.col("c.name").alias("target_column"), "pos", "c.dtype",
        F.coalesce("c.required", F.lit(False)).alias("required"), F.coalesce("c.unique", F.lit(False)).alias("unique"),
        F.coalesce("c.allowed_values", F.array().cast("array<string>")).alias("allowed_values"))


def read_contracts(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Contract documents as flat target columns."""
    return contract_columns(spark.read.schema(TARGET_SCHEMA).option("multiLine", multi_line).json(path))


def find_contract(spark: SparkSession, folder: str) -> str | None:
    """Contract file of a folder: a preferred name, else the first JSON file."""
    names = (spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
             .select("path", F.element_at(F.split("path", "/"), -1).alias("name")))
    ranks = F.create_map(*[F.lit(x) for i, n in enumerate(CONTRACT_NAMES) for x in (n, i)])
    rank = F.coalesce(F.try_element_at(ranks, F.col("name")), F.lit(len(CONTRACT_NAMES)))
    best = names.orderBy(rank, "name").select("path").head()
    return best["path"] if best else None


def target_tables(contract: DataFrame) -> list[TargetTable]:
    """Driver-side contract of one spec (a few hundred columns at most)."""
    tables: dict[str, list[TargetColumn]] = {}
    for r in contract.orderBy("target_table", "pos").toLocalIterator():
        tables.setdefault(r["target_table"], []).append(TargetColumn(
            r["target_column"], r["dtype"], r["required"], r["unique"], tuple(r["allowed_values"])))
    return [TargetTable(n, tuple(c)) for n, c in tables.items()]


def log_entries(updates: DataFrame, key: str, at: str) -> DataFrame:
    """State changes as JSON log lines."""
    fields = [c for c in updates.columns if c not in (key, at)]
    return updates.select(key, at, F.to_json(F.struct(*fields)).alias("entry"))


def merge_log(entries: DataFrame, key: str, at: str | Column) -> DataFrame:
    """Merge JSON log lines per key, the newest value of each field wins."""
    fields = entries.select(key, F.col(at).alias("_at") if isinstance(at, str) else at.alias("_at"),
                            F.explode(F.from_json("entry", "map<string,string>")).alias("field", "value"))
    return fields.groupBy(key, "field").agg(F.max_by("value", "_at").alias("value"))

"""Loading what discovery has catalogued."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.operators.discovery import Catalog
from mapweave.sources.blocks import file_hashes
from mapweave.sources.tabular import CsvLayout, read_delimited


def layouts(catalog: Catalog) -> dict[str, tuple[str, CsvLayout]]:
    """(file_id, layout) of each catalogued delimited table, by table id.

    One row per table reaches the driver, with its column names.
    """
    listed = catalog.columns.groupBy("source_table_id").agg(F.array_sort(F.collect_list(
        F.struct("ordinal", "normalized_name", "load_type"))).alias("listed"))
    rows = catalog.tables.join(listed, "source_table_id").select(
        "source_table_id", F.col("file_id").cast("string").alias("file_id"), "delimiter", "encoding", "header_row",
        "multi_line", "listed")
    return {r.source_table_id: (r.file_id, CsvLayout(
        tuple(c.normalized_name for c in r.listed), r.delimiter, encoding=r.encoding, header_row=r.header_row,
        types=tuple(c.load_type for c in r.listed), multi_line=r.multi_line)) for r in rows.toLocalIterator()}


def _plain(path: str) -> Column:
    """A path without scheme and host."""
    return F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def load_catalog(spark: SparkSession, catalog: Catalog, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    """Lazy frame per catalogued table id from the files' paths.

    ``paths``: file_id to path. Each file must have the bytes that were
    catalogued; a missing or changed one is an error before anything is read.
    All files are hashed in one job.
    """
    wanted = layouts(catalog)
    lost = sorted({f for f, _ in wanted.values()} - set(paths))
    if lost:
        raise ValueError(f"no path for the catalogued files {lost}")
    expected = catalog.tables.select(F.col("file_id").cast("string").alias("file_id"), "file_sha256").distinct()
    named = spark.createDataFrame([(f, paths[f].rstrip("/")) for f in sorted({f for f, _ in wanted.values()})],
                                  "file_id string, path string").withColumn("path", _plain("path"))
    found = file_hashes(spark, sorted({paths[f] for f, _ in wanted.values()})).select(
        _plain("file_id").alias("file"), F.col("file_sha256").alias("now"))
    # A path may name a file or the folder that holds its parts.
    folder = F.regexp_replace("file", "/[^/]*$", "")
    now = found.select(F.explode(F.array("file", folder)).alias("path"), "now").groupBy("path").agg(
        F.when(F.count("*") == 1, F.max("now")).alias("now"))
    changed = named.join(expected, "file_id").join(now, "path", "left").where(~F.col("file_sha256").eqNullSafe(F.col("now")))
    for row in changed.orderBy("file_id").select("file_id").toLocalIterator():
        raise ValueError(f"the file {row.file_id} is not the catalogued one")
    return {table: read_delimited(spark, paths[file_id], layout) for table, (file_id, layout) in wanted.items()}

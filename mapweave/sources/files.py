"""Raw files: folder scan, type detection, fingerprints, registry, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File type by extension.
EXTENSION_TYPES = {
    "csv": "csv", "xlsx": "xlsx", "xls": "xlsx", "pdf": "pdf", "eml": "eml", "msg": "eml",
    "txt": "txt", "md": "md", "docx": "docx",
}
# MIME type by file type.
MIME_TYPES = {
    "csv": "text/csv",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pdf": "application/pdf",
    "eml": "message/rfc822",
    "txt": "text/plain",
    "md": "text/markdown",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}


def _mapped(key: Column, mapping: dict[str, str], default: str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def scan_folder(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Files of a folder except JSON: path, name, length, modificationTime, content.

    ``content`` is only read by queries that use it.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
             .withColumn("name", F.element_at(F.split("path", "/"), -1)))
    return files.where(~F.lower("name").endswith(".json"))


def file_type(name: Column, content: Column | None = None) -> Column:
    """Type by extension, else by magic bytes, else ``unknown``."""
    extension = F.element_at(F.split(F.lower(name), r"\."), -1)
    extension = F.when(name.contains("."), extension)
    by_magic = F.lit("unknown")
    if content is not None:
        head = F.hex(F.substring(content, 1, 4))
        by_magic = (F.when(head.startswith(b"PK".hex().upper()), "xlsx")
                    .when(head == b"%PDF".hex().upper(), "pdf").otherwise("unknown"))
    known = F.create_map(*[F.lit(x) for kv in EXTENSION_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, extension), by_magic)


def mime_type(kind: Column) -> Column:
    """MIME type of a file type."""
    return _mapped(kind, MIME_TYPES, "application/octet-stream")


def fingerprint(content: Column) -> Column:
    """SHA-256 of the bytes, in hex."""
    return F.sha2(content, 256)


def storage_key(client: Column, batch: Column, name: Column, sha256: Column) -> Column:
    """``client/batch/<16 hex digits>_<name>`` with slashes in the name replaced."""
    return F.concat_ws("/", client, batch, F.concat(F.substring(sha256, 1, 16), F.lit("_"),
                                                    F.translate(name, "/", "_")))


def registry_rows(files: DataFrame, client: Column, batch: Column) -> DataFrame:
    """One registry row per file (name, content); the bytes are read once and not kept."""
    kind = file_type(F.col("name"), F.col("content"))
    return files.select(
        client.alias("client"), batch.alias("batch"), F.col("name").alias("original_filename"),
        fingerprint(F.col("content")).alias("sha256"), F.length("content").cast("bigint").alias("size_bytes"),
        kind.alias("file_type")).select(
        "*", mime_type(F.col("file_type")).alias("mime_type"),
        storage_key(F.col("client"), F.col("batch"), F.col("original_filename"), F.col("sha256")).alias("storage_key"),
        F.lit("uploaded").alias("status"))


def ingest_summary(files: DataFrame, *keys: str) -> DataFrame:
    """Parsed and failed counts per batch; merges map-side, so batch size does not matter."""
    return files.groupBy(*keys).agg(
        F.count("*").alias("files"), F.count_if(F.col("status") == "parsed").alias("parsed_count"),
        F.count_if(F.col("status") == "failed").alias("failed_count"))


def resolve_files(tables: DataFrame, files: DataFrame) -> DataFrame:
    """File of every catalog table, or why there is none.

    ``tables``: source_table_id, original_filename, raw_file_id, file_sha256.
    ``files``: name, sha256. A file fits by its original name or by a name
    that starts with ``<raw_file_id>_``; exactly one must fit and its content
    must be the catalogued one. Both ways are equi joins.
    """
    named = tables.join(files, F.col("original_filename") == F.col("name"))
    prefixed = files.where(F.col("name").contains("_")).withColumn("_raw", F.substring_index("name", "_", 1))
    by_id = tables.join(prefixed, F.col("raw_file_id") == F.col("_raw"))
    fits = (named.select("source_table_id", "name", "sha256")
            .unionByName(by_id.select("source_table_id", "name", "sha256"))
            .groupBy("source_table_id", "name").agg(F.first("sha256").alias("sha256"))
            .groupBy("source_table_id").agg(F.count("*").alias("n"), F.min("name").alias("name"),
                                            F.min_by("sha256", "name").alias("sha256")))
    joined = tables.join(fits, "source_table_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    expected = F.nullif("file_sha256", F.lit(""))
    problem = (F.when(F.col("n") != 1, F.format_string("expected one file, found %d", F.col("n")))
               .when(expected.isNotNull() & (expected != F.col("sha256")), "content hash mismatch"))
    return joined.select("source_table_id", F.when(F.col("n") == 1, F.col("name")).alias("name"),
                         problem.alias("problem"))

"""The two jobs a client runs: ingest a folder, and execute an approved spec."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.functions.encoding import decode_text
from mapweave.operators.audit import write_runs
from mapweave.operators.discovery import Catalog, discover_delimited
from mapweave.operators.evidence import chunks, choose_text
from mapweave.operators.mapping import apply_spec
from mapweave.operators.profile import staging_metadata
from mapweave.operators.rules import rules_of, run_rules
from mapweave.schemas import MappingColumn, TargetTable
from mapweave.sources.email import parse_messages
from mapweave.sources.files import file_type, ingest_summary, registry_rows, scan_folder
from mapweave.sources.tables import append, stage


@dataclass
class Ingested:
    """``registry`` and ``summary`` of a batch, its ``catalog`` and evidence ``chunks``."""

    registry: DataFrame
    summary: DataFrame
    catalog: Catalog
    chunks: DataFrame


def ingest_folder(spark: SparkSession, folder: str, client: str, batch: str) -> Ingested:
    """Register a folder's files, catalog its tables and chunk its texts.

    The bytes are staged once; a file that cannot be read is marked failed and
    does not stop the batch. Ids are the content hash and name.
    """
    files = stage(scan_folder(spark, folder).select("name", "content")
                  .withColumn("kind", file_type(F.col("name"), F.col("content")))
                  .withColumn("file_id", F.concat_ws("/", F.sha2("content", 256), "name")), "files")
    catalog = discover_delimited(files.where("kind = 'csv'").select("file_id", "content"))
    texts = files.where(F.col("kind").isin("txt", "md", "eml")).select("file_id", "kind", decode_text(F.col("content")).alias("raw"))
    parsed = parse_messages(texts)
    text = choose_text(F.lit(None).cast("string"), F.when(F.col("kind") != "eml", F.col("raw")), F.col("body_text"))
    evidence = chunks(parsed.select("file_id", text.alias("text")))
    broken = catalog.warnings.where("code = 'malformed'").select("file_id").distinct().withColumn("_failed", F.lit(True))
    ids = F.concat_ws("/", "sha256", "original_filename")
    registry = (registry_rows(files, F.lit(client), F.lit(batch)).withColumn("file_id", ids)
                .join(broken, "file_id", "left")
                .withColumn("status", F.when(F.col("_failed"), "failed")
                            .when(F.col("file_type").isin("csv", "txt", "md", "eml"), "parsed").otherwise("unsupported")).drop("_failed"))
    return Ingested(registry, ingest_summary(registry, "client", "batch"), catalog, evidence)


@dataclass
class Executed:
    """Run id, stored ``targets``, rule ``results`` and ``staging`` metadata."""

    run_id: str
    targets: dict[str, DataFrame]
    results: DataFrame
    staging: DataFrame


def execute(spark: SparkSession, spec_id: str, status: str, columns: Iterable[MappingColumn],
            sources: Mapping[str, DataFrame], contract: Iterable[TargetTable], folder: str) -> Executed:
    """Run an approved spec into ``folder``: targets, rule results, metadata, run record.

    Each target is computed once and stored as parquet; rules and metadata
    read what was stored.
    """
    if status != "approved":
        raise ValueError(f"spec {spec_id} is {status}, not approved")
    columns, contract = list(columns), list(contract)
    run_id, started = str(uuid.uuid4()), datetime.now(UTC).replace(tzinfo=None)
    base = f"{folder.rstrip('/')}/{run_id}"
    rules = rules_of(columns, contract)
    targets, results, staging = {}, None, None
    for name, df in apply_spec(columns, sources, contract).items():
        path = f"{base}/targets/{name}"
        df.write.parquet(path)
        targets[name] = spark.read.schema(df.schema).parquet(path)
        ids = spark.createDataFrame(
            [(c.target_column, c.column_id, c.sort_order) for c in columns if c.target_table == name and c.kind != "filter"],
            "target_column string, mapping_column_id string, sort_order int")
        found = run_rules(targets[name], [r for r in rules if r.table == name]).withColumn("run_id", F.lit(run_id))
        described = staging_metadata(name, targets[name], ids).withColumn("run_id", F.lit(run_id))
        results = found if results is None else results.unionByName(found)
        staging = described if staging is None else staging.unionByName(described)
    for kind, rows in (("validation_results", results), ("staging_columns", staging)):
        if rows is not None:
            append(rows, f"{folder.rstrip('/')}/{kind}")
    record = spark.createDataFrame([(run_id, spec_id, "success", started, datetime.now(UTC).replace(tzinfo=None))],
                                   "run_id string, spec_id string, status string, started_at timestamp_ntz, finished_at timestamp_ntz")
    write_runs(record, f"{folder.rstrip('/')}/runs")
    mine = F.col("run_id") == run_id
    return Executed(run_id, targets, spark.read.parquet(f"{folder.rstrip('/')}/validation_results").where(mine),
                    spark.read.parquet(f"{folder.rstrip('/')}/staging_columns").where(mine))

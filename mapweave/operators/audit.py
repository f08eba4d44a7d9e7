"""Audit log, lineage, provenance and run metadata as ordinary datasets."""

from __future__ import annotations

import math
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from mapweave.functions.scalar import snippet
from mapweave.session import shared_dir
from mapweave.sources.tables import append, append_by_day

MAX_LISTED = 500
#: Parts that the specs of one client are dealt into.
CLIENT_PARTS = 16
#: Specs, and rules, of a client that are paired as one row.
BLOCK_ROWS = 256


def write_audit(entries: DataFrame, path: str) -> None:
    """Append audit entries (…, recorded_at), partitioned by day."""
    append_by_day(entries, path, "recorded_at")


def write_runs(runs: DataFrame, path: str) -> None:
    """Append run records (run_id, spec_id, status, started_at, finished_at)."""
    append_by_day(runs, path, "started_at")


def write_lineage(edges: DataFrame, path: str) -> None:
    """Append lineage edges, partitioned by their type."""
    append(edges, path, "edge_type")


def list_latest(df: DataFrame, filters: Mapping[str, Any], at: str, key: str, limit: int) -> DataFrame:
    """Rows that match all given (non-null) filters, newest first, then by key."""
    for column, value in filters.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df.orderBy(F.col(at).desc_nulls_last(), key).limit(limit)


def query_audit(log: DataFrame, limit: int = 50, at: str = "recorded_at", key: str = "id", **filters: Any) -> DataFrame:
    """Newest audit entries; ``limit`` is between 1 and 500."""
    if not 1 <= limit <= MAX_LISTED:
        raise ValueError(f"limit must be between 1 and {MAX_LISTED}")
    return list_latest(log, filters, at, key, limit)


def lineage_edges(columns: DataFrame) -> DataFrame:
    """Edges of a spec: source column to mapping column to output column.

    ``columns``: mapping_column_id, target_table, target_column,
    source_columns ARRAY<STRUCT<source_column_id>>.
    """
    def edge(source_type: str, source: Column, target_type: str, target: Column, kind: str) -> list[Column]:
        return [F.lit(source_type).alias("source_type"), source.alias("source_id"),
                F.lit(target_type).alias("target_type"), target.alias("target_id"), F.lit(kind).alias("edge_type")]

    mapping = F.col("mapping_column_id")
    inputs = columns.select("mapping_column_id", F.explode("source_columns").alias("s"))
    outputs = columns.select(*edge("mapping_column", mapping, "staging_column",
                                   F.concat_ws(".", "target_table", "target_column"), "produces"))
    return inputs.select(*edge("source_column", F.col("s.source_column_id"), "mapping_column", mapping, "feeds")).unionByName(outputs)


def lineage_of(edges: DataFrame, node: Any) -> DataFrame:
    """One hop around a node: edges into it (upstream) and out of it (downstream)."""
    into = edges.where(F.col("target_id") == node).withColumn("direction", F.lit("upstream"))
    out_of = edges.where(F.col("source_id") == node).withColumn("direction", F.lit("downstream"))
    return into.unionByName(out_of)


def provenance(columns: DataFrame, files: DataFrame, evidence: DataFrame, rules: DataFrame) -> DataFrame:
    """What every mapping column was derived from, one row per cited thing.

    ``columns``: spec_id, mapping_column_id, source_columns ARRAY<STRUCT<
    source_column, raw_file_id>>, evidence_ids, rule_ids. ``files``:
    raw_file_id, original_filename. ``evidence``: evidence_id, raw_file_id,
    content. ``rules``: rule_id, rule_text. ``detail`` shows the first 300
    characters of evidence, ``content_sha256`` stands for all of it. Arrays are exploded one by one, so
    they never multiply.
    """
    keys = ["spec_id", "mapping_column_id"]

    def rows(df: DataFrame, kind: str, ref: Column, file: Column, detail: Column, digest: Column) -> DataFrame:
        return df.select(*keys, F.lit(kind).alias("kind"), ref.alias("ref"), F.col("raw_file_id"),
                         file.alias("original_filename"), detail.alias("detail"), digest.alias("content_sha256"))

    sources = columns.select(*keys, F.inline("source_columns")).join(files, "raw_file_id", "left")
    cited = (columns.select(*keys, F.explode("evidence_ids").alias("evidence_id"))
             .join(evidence.select("evidence_id", "raw_file_id", snippet(F.col("content"), 300).alias("shown"), F.sha2("content", 256).alias("digest")), "evidence_id")
             .join(files, "raw_file_id", "left"))
    applied = (columns.select(*keys, F.explode("rule_ids").alias("rule_id")).join(rules, "rule_id")
               .withColumn("raw_file_id", F.lit(None).cast("string")))
    nothing = F.lit(None).cast("string")
    return (rows(sources, "source", F.col("source_column"), F.col("original_filename"), F.lit(None).cast("string"), nothing)
            .unionByName(rows(cited, "evidence", F.col("evidence_id"), F.coalesce("original_filename", F.lit("unknown")),
                              F.translate("shown", "\n", " "), F.col("digest")))
            .unionByName(rows(applied, "rule", F.col("rule_id"), F.lit(None).cast("string"), F.col("rule_text"), nothing)))


def provenance_counts(trace: DataFrame) -> DataFrame:
    """Distinct things cited per spec, counted from distinct citations; texts count in full."""
    seen = trace.select("spec_id", F.inline(F.array(
        F.struct(F.lit("mapping").alias("kind"), F.col("mapping_column_id").cast("string").alias("ref")),
        F.struct(F.when(F.col("kind") != "source", F.col("kind")).alias("kind"), F.col("ref").cast("string").alias("ref")),
        F.struct(F.when(F.col("original_filename").isNotNull(), "file").alias("kind"), F.col("raw_file_id").cast("string").alias("ref")),
        F.struct(F.when(F.col("kind") == "evidence", "snippet").alias("kind"), F.col("content_sha256").alias("ref")),
    ))).where("kind IS NOT NULL AND ref IS NOT NULL").distinct()
    return seen.groupBy("spec_id").agg(*[
        F.count_if(F.col("kind") == k).alias(name) for k, name in (
            ("mapping", "mappings"), ("evidence", "evidence_cited"), ("rule", "rules_cited"),
            ("file", "source_files"), ("snippet", "snippets"))])


def current_state(changes: DataFrame, key: str, at: Column) -> DataFrame:
    """Latest record of each key; merges map-side, however many changes a key has."""
    fields = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*fields), at).alias("_r")).select(key, "_r.*")


def upsert(stored: DataFrame, fresh: DataFrame, key: str, at: str) -> DataFrame:
    """One record per key, the newest of both sides; a tie goes to the fresh one."""
    both = stored.withColumn("_fresh", F.lit(0)).unionByName(fresh.withColumn("_fresh", F.lit(1)))
    return current_state(both, key, F.struct(F.col(at), F.col("_fresh"))).drop("_fresh")


def patch(stored: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Apply partial updates: only fields listed in ``given`` change, also to null.

    ``changes``: key, given ARRAY<STRING> and the new values; one row per key.
    """
    new = changes.select(key, F.col("given").alias("_given"), *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = stored.join(new, key, "left")
    updates = {f: F.when(F.array_contains(F.coalesce("_given", F.array().cast("array<string>")), f), F.col(f"_new_{f}"))
               .otherwise(F.col(f)) for f in fields}
    return joined.withColumns(updates).select(*stored.columns)


def _client_blocks(rows: DataFrame, columns: list[str], out: str, size: int) -> DataFrame:
    """(client_id, _part, ``out``): the rows of a part of a client, up to ``size`` in an array."""
    place = F.row_number().over(W.partitionBy("client_id", "_part").orderBy("_part"))
    return rows.withColumn("_block", F.floor((place - 1) / size)).groupBy("client_id", "_part", "_block").agg(
        F.collect_list(F.struct(*columns)).alias(out)).drop("_block")


def active_rules(rules: DataFrame, specs: DataFrame, parts: int = CLIENT_PARTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Approved rules of the clients that have a spec at work, per spec.

    The specs of a client are dealt into ``parts`` by their id, and its rules go to
    each part, so the few clients with most specs do not set the number of tasks.

    The result is every pair of a spec and a rule of its client. Blocks of specs meet
    blocks of rules, and the pairs of two blocks come rule by rule, each beside the same
    specs in the same order: written by column, that takes a fraction of the disk of
    pairs that come spec by spec.
    """
    approved = rules.where((F.col("status") == "approved") & F.col("client_id").isNotNull()).drop("status")
    dealt = specs.where("client_id IS NOT NULL").select(
        "spec_id", "client_id", F.pmod(F.xxhash64("spec_id"), F.lit(parts)).alias("_part"))
    copies = approved.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
    columns = [c for c in approved.columns if c != "client_id"]
    of_specs = _client_blocks(dealt, ["spec_id"], "_specs", block_rows).withColumn("_specs", F.col("_specs.spec_id"))
    # Merged, so that either side may go to disk; a broadcast would take the blocks in another order.
    met = of_specs.join(_client_blocks(copies, columns, "_rules", block_rows).hint("merge"), ["client_id", "_part"])
    # The function keeps this out of the loop generated for the join, which holds all that comes of a row.
    each = met.select("client_id", "_specs", F.inline(F.transform("_rules", lambda r: r)))
    return each.select("client_id", F.explode("_specs").alias("spec_id"), *columns)


class Pages:
    """A result kept in order of a key, with a directory of its parts: any page reads few files.

    The result is cut and sorted by ranges of the key, nulls first; rows of one
    key keep the order of the input and are split over parts like any others.
    The directory has one row for each part, with the number of rows before it.
    A page looks up which parts hold its rows and reads those rows of them.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        schema = spark.read.parquet(f"{path}/schema").schema
        self.rows = spark.read.schema(schema).parquet(f"{path}/rows")
        self.directory = spark.read.parquet(f"{path}/directory")
        self.total = self.directory.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]

    @classmethod
    def write(cls, df: DataFrame, order: str, path: str) -> Pages:
        by = [F.col(order).asc_nulls_first(), F.col("_at")]
        cut = df.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
        row = F.monotonically_increasing_id()
        placed = cut.drop("_at").withColumn("_row", row.bitwiseAND((1 << 33) - 1)).withColumn("_part", F.shiftright(row, 33))
        placed.write.partitionBy("_part").parquet(f"{path}/rows")
        # The rows of an empty result have no files to tell their columns.
        placed.where("false").coalesce(1).write.parquet(f"{path}/schema")
        # One row for each part, so one window over them is small.
        counts = df.sparkSession.read.schema(placed.schema).parquet(f"{path}/rows").groupBy("_part").agg(F.count("*").alias("n"))
        before = F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
        counts.withColumn("before", F.coalesce(before, F.lit(0))).coalesce(1).write.parquet(f"{path}/directory")
        return cls(df.sparkSession, path)

    def page(self, number: int, size: int) -> tuple[DataFrame, dict[str, int]]:
        """Page ``number`` (1-based, clamped to the last), in order, and where it stands."""
        pages = max(1, math.ceil(self.total / size))
        number = min(max(1, number), pages)
        start = (number - 1) * size
        count = min(size, self.total - start)
        facts = {"page": number, "total_pages": pages, "total_rows": self.total, "start_row": start + 1, "end_row": start + count}
        held = self.directory.where((F.col("before") < start + count) & (F.col("before") + F.col("n") > start)).collect()
        wanted = F.lit(False)
        for part in held:
            low, high = max(start - part.before, 0), min(start + count - part.before, part.n)
            wanted = wanted | ((F.col("_part") == part._part) & (F.col("_row") >= low) & (F.col("_row") < high))
        parts = F.col("_part").isin([part._part for part in held])
        return self.rows.where(parts & wanted).orderBy("_part", "_row").drop("_part", "_row"), facts


def page(df: DataFrame, order: str, number: int, size: int) -> tuple[DataFrame, dict[str, int]]:
    """One page of rows in order of a key, as `Pages` gives it; to turn pages, keep the `Pages`."""
    return Pages.write(df, order, shared_dir(df.sparkSession, "pages")).page(number, size)

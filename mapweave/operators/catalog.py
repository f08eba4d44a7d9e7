"""Source-catalog resolution and checks of mapping proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.schemas import CATALOG, PROPOSAL, SOURCE_TABLE
from mapweave.sources.tables import replace_partitions

KEY_SEPARATOR = "::"


def first_filled(*columns: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def _table_key() -> Column:
    return F.concat_ws(
        KEY_SEPARATOR, F.coalesce(first_filled(F.col("original_filename")), F.lit("unknown")),
        F.coalesce(first_filled(F.col("display_name"), F.col("sheet_name")), F.lit("")))


def catalog_tables(catalogs: DataFrame, json: str = "catalog_json") -> DataFrame:
    """Tables of catalogs given as JSON text; other columns are carried along.

    A catalog keeps its tables under ``tables``, else under ``sheets``, else it
    is itself one table. ``table_pos`` counts within the catalog.
    """
    carried = [c for c in catalogs.columns if c != json]
    parsed = catalogs.withColumn("_c", F.from_json(json, CATALOG))
    bare = F.array(F.struct(*[F.col(f"_c.{f.name}").alias(f.name) for f in SOURCE_TABLE.fields]))
    flat = parsed.select(*carried, F.posexplode(F.coalesce("_c.tables", "_c.sheets", bare))
                         .alias("table_pos", "_t"))
    return flat.select(*carried, "table_pos",
                       *[F.col(f"_t.{f.name}").alias(f.name) for f in SOURCE_TABLE.fields
                         if f.name not in (*carried, "sheet_name")],
                       first_filled(F.col("_t.location.sheet_name"), F.col("_t.sheet_name")).alias("sheet_name"))


def catalog_columns(tables: DataFrame) -> DataFrame:
    """Columns of catalog tables with their effective name; tables without columns keep a row."""
    rest = [c for c in tables.columns if c not in ("columns", "warnings", "location")]
    flat = tables.select(*rest, F.posexplode_outer("columns").alias("column_pos", "_col"))
    names = [F.col(f"_col.{n}") for n in ("normalized_name", "original_name", "header", "column")]
    return flat.select(
        *rest, "column_pos",
        F.coalesce(first_filled(F.col("_col.source_column_id"), F.col("_col.column")), F.lit("")).alias("source_column_id"),
        F.coalesce(first_filled(*names), F.lit("")).alias("column_name"),
        first_filled(F.col("_col.inferred_type"), F.col("_col.dtype")).alias("inferred_type"))


def column_index(columns: DataFrame) -> DataFrame:
    """``file::sheet::column`` keys; the last catalog entry of a key wins.

    ``columns``: scope, pos, original_filename, display_name, sheet_name,
    source_table_id, source_column_id, raw_file_id, column_name.
    """
    key = F.concat_ws(KEY_SEPARATOR, _table_key(), F.col("column_name"))
    entry = F.struct("source_table_id", "source_column_id", "raw_file_id", "display_name", "column_name")
    return (columns.groupBy("scope", key.alias("key")).agg(F.max_by(entry, "pos").alias("entry"))
            .select("scope", "key", "entry.*"))


def table_index(tables: DataFrame) -> DataFrame:
    """``file::sheet`` keys; the last table wins, at the place of the first.

    ``tables``: scope, pos, original_filename, display_name, sheet_name,
    source_table_id.
    """
    entry = F.struct("source_table_id", "display_name")
    return (tables.groupBy("scope", _table_key().alias("table_key"))
            .agg(F.max_by(entry, "pos").alias("entry"), F.min("pos").alias("place"))
            .select("scope", "table_key", "place", "entry.*"))


def resolve_columns(refs: DataFrame, columns: DataFrame) -> DataFrame:
    """Resolve (source_table, source_column) references of each scope.

    Tiers: exact composite key; exact table with the column name in any case;
    display name and column name in any case, first catalog entry first. What
    none resolves gets an ``error``. Each distinct reference is resolved once
    and joined back, so a reference that most rows share costs one row.
    """
    # A table's position is its first column's; all of its columns share the id.
    tables = columns.groupBy("scope", "source_table_id", "original_filename", "display_name",
                             "sheet_name").agg(F.min("pos").alias("pos"))
    live = table_index(tables).select("scope", "source_table_id", "table_key", "place")
    usable = (columns.join(live, ["scope", "source_table_id"])
              .withColumn("lower_column", F.lower("column_name")))
    entry = F.struct("source_table_id", "source_column_id", "raw_file_id", "display_name", "column_name")

    exact = column_index(columns).select(
        "scope", F.col("key").alias("exact_key"), entry.alias("hit_1"))
    by_table = (usable.groupBy("scope", "table_key", "lower_column")
                .agg(F.min_by(entry, "pos").alias("hit_2")))
    by_display = (usable.where(F.col("display_name").isNotNull())
                  .groupBy("scope", F.lower("display_name").alias("lower_display"), "lower_column")
                  .agg(F.min_by(entry, F.struct("place", "pos")).alias("hit_3")))

    wanted = (refs.select("scope", "source_table", "source_column").distinct()
              .withColumns({"exact_key": F.concat_ws(KEY_SEPARATOR, "source_table", "source_column"),
                            "table_key": F.col("source_table"),
                            "lower_column": F.lower("source_column"),
                            "lower_display": F.lower("source_table")}))
    found = (wanted.join(exact, ["scope", "exact_key"], "left")
             .join(by_table, ["scope", "table_key", "lower_column"], "left")
             .join(by_display, ["scope", "lower_display", "lower_column"], "left"))
    tier = (F.when(F.col("hit_1").isNotNull(), 1).when(F.col("hit_2").isNotNull(), 2)
            .when(F.col("hit_3").isNotNull(), 3))
    resolved = found.select(
        "scope", "source_table", "source_column", tier.alias("tier"),
        F.coalesce("hit_1", "hit_2", "hit_3").alias("hit"))
    error = F.when(F.col("tier").isNull(), F.concat(
        F.lit("source column '"), "source_column", F.lit("' not found for key '"), "source_table", F.lit("'")))
    return (refs.join(resolved, ["scope", "source_table", "source_column"], "left")
            .select(*refs.columns, "tier", "hit.source_table_id", "hit.source_column_id",
                    "hit.raw_file_id", "hit.column_name", error.alias("error")))


def resolve_tables(refs: DataFrame, tables: DataFrame) -> DataFrame:
    """Resolve table keys: exact ``file::sheet``, else display name in any case."""
    index = table_index(tables)
    exact = index.select("scope", "table_key", F.col("source_table_id").alias("id_1"))
    display = (index.where(F.col("display_name").isNotNull())
               .groupBy("scope", F.lower("display_name").alias("lower_display"))
               .agg(F.min_by("source_table_id", "place").alias("id_2")))
    wanted = (refs.select("scope", "table_key").distinct()
              .withColumn("lower_display", F.lower("table_key")))
    found = (wanted.join(exact, ["scope", "table_key"], "left")
             .join(display, ["scope", "lower_display"], "left")
             .select("scope", "table_key", F.coalesce("id_1", "id_2").alias("source_table_id")))
    return refs.join(found, ["scope", "table_key"], "left").withColumn(
        "error", F.when(F.col("source_table_id").isNull(),
                        F.concat(F.lit("'"), "table_key", F.lit("' is not in the catalog"))))


def check_sources(refs: DataFrame, columns: DataFrame) -> DataFrame:
    """First problem of each resolved source reference (ids against the catalog).

    ``refs``: mapping_id, scope, source_table_id, source_column_id, raw_file_id.
    """
    tables = (columns.groupBy("scope", "source_table_id")
              .agg(F.max_by("raw_file_id", "pos").alias("_table_raw"))
              .withColumn("_known", F.lit(True)))
    owners = columns.groupBy("scope", "source_column_id").agg(
        F.max_by("source_table_id", "pos").alias("_owner"))
    joined = (refs.join(tables, ["scope", "source_table_id"], "left")
              .join(owners, ["scope", "source_column_id"], "left"))
    table_id, column_id = F.col("source_table_id"), F.col("source_column_id")
    error = (
        F.when(first_filled(table_id).isNull(), "source_table_id is missing")
        .when(F.col("_known").isNull(), F.concat(F.lit("table "), table_id, F.lit(" is not in the catalog")))
        .when(first_filled(column_id).isNull(), "source_column_id is missing")
        .when(F.col("_owner").isNull() | (F.col("_owner") != table_id),
              F.concat(F.lit("column "), column_id, F.lit(" does not belong to table "), table_id))
        .when(F.col("_table_raw").isNotNull() & ~F.col("raw_file_id").eqNullSafe(F.col("_table_raw")),
              F.concat(F.lit("raw file of column "), column_id, F.lit(" differs from the catalog"))))
    return joined.select("mapping_id", error.alias("error")).where("error IS NOT NULL")


def check_targets(mappings: DataFrame, contract: DataFrame) -> DataFrame:
    """Mappings whose target column the contract does not have."""
    return (mappings.join(contract, ["target_table", "target_column"], "left_anti")
            .select("mapping_id", F.lit("target column not in target schema").alias("error")))


def check_named_columns(mappings: DataFrame, columns: DataFrame, table: str, names: dict[str, str]) -> DataFrame:
    """Problems of a lookup or aggregation source.

    ``table`` is the mapping column with the table id; ``names`` maps mapping
    columns that name a column of that table to the label used in the message.
    """
    asked = mappings.where(first_filled(F.col(table)).isNotNull())
    ids = columns.select("scope", F.col("source_table_id").alias(table)).distinct()
    missing = asked.join(ids, ["scope", table], "left_anti").select(
        "mapping_id", F.concat(F.lit("table "), table, F.lit(" is not in the catalog")).alias("error"))
    wanted = (asked.join(ids, ["scope", table], "left_semi")
              .select("mapping_id", "scope", table, F.inline(F.array(*[
                  F.struct(F.lit(label).alias("label"), F.col(c).alias("column_name")) for c, label in names.items()])))
              .where(first_filled(F.col("column_name")).isNotNull()))
    known = columns.select("scope", F.col("source_table_id").alias(table), "column_name").distinct()
    absent = wanted.join(known, ["scope", table, "column_name"], "left_anti").select(
        "mapping_id", F.concat("label", F.lit(" '"), "column_name", F.lit("' not in table "), table).alias("error"))
    return missing.unionByName(absent)


def coverage(mappings: DataFrame, contract: DataFrame) -> DataFrame:
    """Contract columns marked covered or missing, required or optional."""
    mapped = mappings.select("target_table", "target_column").distinct().withColumn("_m", F.lit(True))
    joined = contract.join(mapped, ["target_table", "target_column"], "left")
    state = F.concat(F.when(F.col("_m"), "covered_").otherwise("missing_"),
                     F.when(F.col("required"), "required").otherwise("optional"))
    return joined.select("target_table", "target_column", state.alias("coverage"))


def parse_proposals(proposals: DataFrame, json: str = "proposal_json") -> DataFrame:
    """Mapping rows of proposal documents with defaults; entry order is ``sort_order``.

    A test that is not text is kept as its JSON. Entries without a target are
    marked ``rejected``.
    """
    carried = [c for c in proposals.columns if c != json]
    rows = proposals.select(*carried, F.posexplode(F.from_json(json, PROPOSAL)["mappings"]).alias("sort_order", "_m"))
    fields = [f.name for f in PROPOSAL["mappings"].dataType.elementType.fields]
    flat = rows.select(*carried, "sort_order", *[F.col(f"_m.{f}").alias(f) for f in fields])
    empty = F.array().cast("array<string>")
    return flat.withColumns({
        "transformation_logic": F.coalesce("transformation_logic", F.lit("")),
        "transformation_type": F.coalesce("transformation_type", F.lit("expression")),
        "tests": F.coalesce("tests", empty), "evidence_ids": F.coalesce("evidence_ids", empty),
        "business_rule_ids": F.coalesce("business_rule_ids", empty),
        "rejected": F.col("target_table").isNull() | F.col("target_column").isNull(),
    })


def replace_spec_columns(columns: DataFrame, path: str) -> None:
    """Replace the stored columns of exactly the specs that ``columns`` holds."""
    replace_partitions(columns, path, "spec_id")

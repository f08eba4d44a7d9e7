"""Record types shared by the operators, and their Spark struct types."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class TargetColumn:
    name: str
    dtype: str | None = None
    required: bool = False
    unique: bool = False
    allowed_values: tuple[str, ...] = ()


@dataclass(frozen=True)
class TargetTable:
    name: str
    columns: tuple[TargetColumn, ...]


@dataclass(frozen=True)
class MappingColumn:
    """One row of a mapping spec; ``source_columns`` are (table id, column) pairs."""

    target_table: str
    target_column: str
    kind: str = "expression"
    source_columns: tuple[tuple[str, str], ...] = ()
    expression: str | None = None
    filter_expression: str | None = None
    lookup_table: str | None = None
    lookup_key: str | None = None
    lookup_value: str | None = None
    aggregation_table: str | None = None
    aggregation_key: str | None = None
    aggregation_expression: str | None = None
    tests: tuple[str, ...] = field(default=())
    sort_order: int = 0
    column_id: str | None = None


_STR = T.StringType()

SOURCE_REF = T.StructType([
    T.StructField("source_table", _STR), T.StructField("source_column", _STR),
    T.StructField("source_table_id", _STR), T.StructField("source_column_id", _STR),
    T.StructField("raw_file_id", _STR),
])

# Proposal document: {"mappings": [...]}; ``tests`` stay raw JSON per entry.
PROPOSAL = T.StructType([T.StructField("mappings", T.ArrayType(T.StructType([
    T.StructField("target_table", _STR), T.StructField("target_column", _STR),
    T.StructField("source_columns", T.ArrayType(SOURCE_REF)),
    T.StructField("transformation_logic", _STR), T.StructField("transformation_type", _STR),
    T.StructField("expression", _STR), T.StructField("filter_expression", _STR),
    T.StructField("aggregation_source_table", _STR), T.StructField("aggregation_expression", _STR),
    T.StructField("aggregation_group_key", _STR), T.StructField("lookup_source_table", _STR),
    T.StructField("lookup_key", _STR), T.StructField("lookup_value", _STR),
    T.StructField("tests", T.ArrayType(_STR)), T.StructField("evidence_ids", T.ArrayType(_STR)),
    T.StructField("business_rule_ids", T.ArrayType(_STR)), T.StructField("confidence", T.DoubleType()),
])))])

WARNING = T.StructType([
    T.StructField("code", _STR), T.StructField("message", _STR),
    T.StructField("severity", _STR), T.StructField("location", _STR),
])

SOURCE_COLUMN = T.StructType([
    T.StructField("source_column_id", _STR), T.StructField("ordinal", T.IntegerType()),
    T.StructField("original_name", _STR), T.StructField("normalized_name", _STR),
    T.StructField("header", _STR), T.StructField("column", _STR),
    T.StructField("inferred_type", _STR), T.StructField("dtype", _STR),
    T.StructField("null_count", T.LongType()), T.StructField("cardinality", T.LongType()),
    T.StructField("unique_count", T.LongType()),
])

SOURCE_TABLE = T.StructType([
    T.StructField("source_table_id", _STR), T.StructField("raw_file_id", _STR),
    T.StructField("file_sha256", _STR), T.StructField("original_filename", _STR),
    T.StructField("display_name", _STR), T.StructField("sheet_name", _STR),
    T.StructField("source_table", _STR),
    T.StructField("location", T.StructType([
        T.StructField("sheet_name", _STR), T.StructField("header_row", T.LongType()),
        T.StructField("encoding", _STR), T.StructField("delimiter", _STR),
        T.StructField("quote_char", _STR),
    ])),
    T.StructField("row_count", T.LongType()),
    T.StructField("columns", T.ArrayType(SOURCE_COLUMN)),
    T.StructField("warnings", T.ArrayType(WARNING)),
])

# A catalog keeps its tables under "tables", under "sheets", or is itself a bare table.
CATALOG = T.StructType([
    T.StructField("raw_file_id", _STR), T.StructField("file_type", _STR),
    T.StructField("tables", T.ArrayType(SOURCE_TABLE)),
    T.StructField("sheets", T.ArrayType(SOURCE_TABLE)),
    *[f for f in SOURCE_TABLE.fields if f.name != "raw_file_id"],
])

TARGET_SCHEMA = T.StructType([T.StructField("tables", T.ArrayType(T.StructType([
    T.StructField("name", _STR),
    T.StructField("columns", T.ArrayType(T.StructType([
        T.StructField("name", _STR), T.StructField("dtype", _STR),
        T.StructField("required", T.BooleanType()), T.StructField("unique", T.BooleanType()),
        T.StructField("allowed_values", T.ArrayType(_STR)),
    ]))),
])))])


def ordered(columns: Iterable[MappingColumn]) -> list[MappingColumn]:
    """Spec rows in their stored order."""
    return sorted(columns, key=lambda c: c.sort_order)

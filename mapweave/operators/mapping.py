"""Mapping execution: a spec and its sources become one lazy frame per target."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapweave.functions.scalar import parse_date
from mapweave.operators.heavy import HOT_ROWS, join_grouped
from mapweave.schemas import MappingColumn, TargetTable, ordered

# Target type names and their Spark types.
DTYPES = {
    "Int8": "tinyint", "Int16": "smallint", "Int32": "int", "Int64": "bigint",
    "UInt8": "smallint", "UInt16": "int", "UInt32": "bigint", "UInt64": "decimal(20,0)",
    "Float32": "float", "Float64": "double", "Decimal": "decimal(38,18)",
    "String": "string", "Utf8": "string", "Boolean": "boolean",
    "Date": "date", "Datetime": "timestamp_ntz",
}
_UNSIGNED_BITS = {"UInt8": 8, "UInt16": 16, "UInt32": 32, "UInt64": 64}
# Date layouts accepted where a target says Date and names no format.
_DATE_LAYOUTS = ("yyyy-M-d", "yyyy/M/d", "d-M-yyyy", "d/M/yyyy")


def _named(column: str) -> Column:
    """Column by its plain name, dots included."""
    return F.col(f"`{column}`")


def choose_base(target_table: str, columns: Iterable[MappingColumn],
                sources: Mapping[str, DataFrame]) -> str:
    """Source of the first column that has one, else the target's own name.

    A key that is not a loaded source falls back to its file stem.
    """
    key = next((c.source_columns[0][0] for c in ordered(columns) if c.source_columns), target_table)
    if key not in sources and PurePosixPath(key).stem in sources:
        return PurePosixPath(key).stem
    return key


def base_tables(columns: DataFrame) -> DataFrame:
    """``choose_base`` for a whole table of spec rows.

    Input: spec_id, target_table, sort_order, source_table (null without
    sources). ``min_by`` merges map-side, so a spec with very many rows is no
    hot task.
    """
    usable = F.when(F.col("source_table").isNotNull(), F.col("sort_order"))
    return columns.groupBy("spec_id", "target_table").agg(
        F.coalesce(F.min_by("source_table", usable), F.first("target_table")).alias("base_source"))


def lookup(df: DataFrame, table: DataFrame, left_key: str, key: str, value: str,
           target: str) -> DataFrame:
    """Left equi join with the distinct (key, value) pairs of another source.

    A key with several values multiplies rows; null keys match nothing. Only
    two columns of the lookup reach the join. No broadcast is forced: AQE
    broadcasts a small lookup by its measured size and otherwise splits the
    partitions of hot keys.
    """
    pairs = (table.where(_named(key).isNotNull())
             .select(_named(key).alias("_lookup_key"), _named(value).alias("_lookup_value"))
             .distinct())
    joined = df.join(pairs, _named(left_key) == F.col("_lookup_key"), "left")
    return joined.withColumn(target, F.col("_lookup_value")).drop("_lookup_key", "_lookup_value")


def duplicate_lookup_keys(table: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of a lookup source with more than one value, which fan rows out."""
    return (table.where(_named(key).isNotNull()).select(_named(key), _named(value)).distinct()
            .groupBy(_named(key)).agg(F.count("*").alias("n_values")).where("n_values > 1"))


def aggregate_join(df: DataFrame, table: DataFrame, base_key: str, key: str,
                   aggregates: Mapping[str, str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Group another source by one key and left join all aggregates at once.

    Base rows of hot keys, which a sketch names, and of null keys are joined
    where they lie (`heavy.join_grouped`); nothing is copied for the others.
    """
    names = {target: f"_agg_{i}" for i, target in enumerate(aggregates)}
    grouped = (table.where(_named(key).isNotNull())
               .groupBy(_named(key).alias("_agg_key"))
               .agg(*[F.expr(text).alias(names[target]) for target, text in aggregates.items()]))
    joined = join_grouped(df, grouped, _named(base_key), "_agg_key", hot_rows)
    return joined.withColumns({target: F.col(n) for target, n in names.items()}).drop("_agg_key", *names.values())


def _value(col: MappingColumn) -> Column:
    if not col.source_columns:
        return F.lit(None)
    return F.expr(col.expression) if col.expression else F.col(f"`{col.source_columns[0][1]}`")


def _project(df: DataFrame, columns: list[MappingColumn]) -> DataFrame:
    """Evaluate expression columns in order; later ones see earlier targets.

    New names share one select through lateral column aliases, which keeps the
    plan shallow. A name that already exists is overwritten on its own, so
    that later expressions read the new value.
    """
    pending: dict[str, Column] = {}

    def flush(frame: DataFrame) -> DataFrame:
        return frame.select("*", *[c.alias(n) for n, c in pending.items()]) if pending else frame

    for col in columns:
        taken = {n.lower() for n in (*df.columns, *pending)}
        if col.target_column.lower() in taken:
            df = flush(df).withColumn(col.target_column, _value(col))
            pending = {}
        else:
            pending[col.target_column] = _value(col)
    return flush(df)


def _same_aggregation(a: MappingColumn, b: MappingColumn) -> bool:
    def parts(c: MappingColumn):
        return (c.kind, c.aggregation_table, c.aggregation_key,
                c.source_columns[0][1] if c.source_columns else c.aggregation_key)

    return parts(a) == parts(b)


def build_target(columns: Iterable[MappingColumn], sources: Mapping[str, DataFrame],
                 base: DataFrame) -> DataFrame:
    """One target table: all filters first, then the columns in spec order."""
    rows = ordered(columns)
    df = base
    for col in rows:
        if col.kind == "filter":
            df = df.where(F.expr(col.filter_expression))
    todo = [c for c in rows if c.kind != "filter"]
    names = [c.target_column for c in todo]
    while todo:
        col = todo[0]
        if col.kind == "lookup":
            left = col.source_columns[0][1] if col.source_columns else col.lookup_key
            df = lookup(df, sources[col.lookup_table], left, col.lookup_key,
                        col.lookup_value, col.target_column)
            todo = todo[1:]
        elif col.kind == "aggregation":
            # Neighbours over the same source and key share one group-by and one join.
            run = [col]
            left = col.source_columns[0][1] if col.source_columns else col.aggregation_key
            while (len(run) < len(todo) and _same_aggregation(col, todo[len(run)])
                   and left not in {c.target_column for c in run}):
                run.append(todo[len(run)])
            df = aggregate_join(df, sources[col.aggregation_table], left, col.aggregation_key,
                                {c.target_column: c.aggregation_expression for c in run})
            todo = todo[len(run):]
        else:
            run = []
            while len(run) < len(todo) and todo[len(run)].kind == "expression":
                run.append(todo[len(run)])
            df = _project(df, run)
            todo = todo[len(run):]
    return df.select(*[F.col(f"`{n}`") for n in dict.fromkeys(names)])


def _enforced(c: Column, have: T.DataType, dtype: str) -> Column:
    if isinstance(have, T.NullType):
        return c.cast(DTYPES[dtype])
    if dtype == "Date":
        if isinstance(have, T.DateType):
            return c
        if isinstance(have, (T.TimestampType, T.TimestampNTZType)):
            return F.to_date(c)
        text = c.cast("string")
        return F.coalesce(*[parse_date(text, layout) for layout in _DATE_LAYOUTS])
    if dtype == "Datetime":
        return c if isinstance(have, T.TimestampNTZType) else c.try_cast("timestamp_ntz")
    cast = c.try_cast(DTYPES[dtype])
    bits = _UNSIGNED_BITS.get(dtype)
    return cast if bits is None else F.when((cast >= 0) & (cast < F.expr(f"{2**bits}BD")), cast)


def enforce_dtypes(df: DataFrame, table: TargetTable) -> DataFrame:
    """Cast to the target contract; values that do not fit become null."""
    types = {f.name: f.dataType for f in df.schema.fields}
    casts = {c.name: _enforced(F.col(f"`{c.name}`"), types[c.name], c.dtype)
             for c in table.columns if c.dtype in DTYPES and c.name in types}
    return df.withColumns(casts) if casts else df


def apply_spec(columns: Iterable[MappingColumn], sources: Mapping[str, DataFrame],
               target_schema: Iterable[TargetTable] = ()) -> dict[str, DataFrame]:
    """All target tables of a spec, in name order, each an independent lazy plan."""
    by_table: dict[str, list[MappingColumn]] = {}
    for col in columns:
        by_table.setdefault(col.target_table, []).append(col)
    contracts = {t.name: t for t in target_schema}
    result = {}
    for name in sorted(by_table):
        base = sources[choose_base(name, by_table[name], sources)]
        df = build_target(by_table[name], sources, base)
        result[name] = enforce_dtypes(df, contracts[name]) if name in contracts else df
    return result

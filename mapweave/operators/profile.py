"""Column profiles: each is one aggregation pass over a frame.

Values go through one unpivot into (column, value) pairs where exact distinct
counts are wanted: the distinct step then shuffles on (column, value), so
neither a column with most of the values nor a repeated value makes a hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

_BOOLEAN = r"(?i)^\s*(true|false)\s*$"
_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, ordinal, value as text) rows."""
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(i + 1).alias("ordinal"),
                 F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(columns)])))


def first_values(df: DataFrame, columns: list[str], order: list[Column], n: int,
                 blank: bool = False) -> DataFrame:
    """First ``n`` present values of each column in an explicit order.

    One scan for all columns; the rank limit prunes each partition to ``n`` rows
    per column before the shuffle. Blanks count as present only if ``blank``.
    """
    key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    cells = df.select(key.alias("_order"), F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]).alias("_cells"))
    cells = cells.select("_order", F.inline("_cells"))
    present = F.col("value").isNotNull() if blank else F.col("value").isNotNull() & (F.col("value") != "")
    rank = F.row_number().over(W.partitionBy("column").orderBy("_order"))
    # At most n rows per column are left here.
    return cells.where(present).withColumn("_r", rank).where(F.col("_r") <= n).groupBy("column").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_order", "value"))), lambda x: x["value"]).alias("examples"))


def infer_types(df: DataFrame) -> DataFrame:
    """Type label and load type of every column, over all of its values.

    A column gets the first label that all its present values fit. Text
    columns are also tried for the type a CSV load would give them (boolean,
    bigint, double, else string).
    """
    fields = df.schema.fields
    native = {T.BooleanType: "boolean", T.ByteType: "integer", T.ShortType: "integer",
              T.IntegerType: "integer", T.LongType: "integer", T.FloatType: "number",
              T.DoubleType: "number", T.DecimalType: "number", T.TimestampType: "datetime",
              T.TimestampNTZType: "datetime", T.DateType: "date"}
    loads = {"boolean": "boolean", "integer": "bigint", "number": "double"}
    checks, rows = [], []
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        text = isinstance(f.dataType, T.StringType)
        present = F.nullif(c, F.lit("")) if text else c
        checks.append(F.count(present).alias(f"n{i}"))
        label = native.get(type(f.dataType), "string")
        load = F.lit(loads.get(label, "string"))
        if text:
            whole = present.try_cast("bigint").isNotNull()
            checks += [F.every(present.rlike(_BOOLEAN)).alias(f"b{i}"),
                       F.every(present.rlike(_INTEGER) & whole).alias(f"i{i}"),
                       F.every(present.rlike(_NUMBER)).alias(f"d{i}")]
            load = (F.when(F.col(f"b{i}"), "boolean").when(F.col(f"i{i}"), "bigint")
                    .when(F.col(f"d{i}"), "double").otherwise("string"))
        rows.append(F.struct(
            F.lit(f.name).alias("column"),
            F.when(F.col(f"n{i}") == 0, "null").otherwise(label).alias("inferred_type"),
            F.when(F.col(f"n{i}") == 0, "string").otherwise(load).alias("load_type")))
    return df.agg(*checks).select(F.inline(F.array(*rows)))


def catalog_profile(df: DataFrame, order: list[Column], columns: list[str] | None = None,
                    examples: int = 5, approx: bool = False) -> DataFrame:
    """Source-catalog statistics: blanks, cardinality as text, key score, examples."""
    columns = columns or df.columns
    value = F.nullif(F.col("value"), F.lit(""))
    distinct = F.approx_count_distinct(value) if approx else F.countDistinct(value)
    stats = (_pairs(df, columns).groupBy("column", "ordinal")
             .agg(F.count("*").alias("n"), F.count(value).alias("present"), distinct.alias("cardinality")))
    present, n = F.col("present").cast("decimal(20,0)"), F.col("n").cast("decimal(20,0)")
    # uniqueness x completeness = (distinct / present) x (present / rows)
    score = F.when(F.col("present") > 0, F.bround(F.try_divide(F.col("cardinality").cast("decimal(20,0)"), n), 4))
    stats = stats.select(
        "column", "ordinal", (F.col("n") - F.col("present")).alias("null_count"),
        F.coalesce(F.try_divide((n - present).cast("double"), n.cast("double")), F.lit(0.0)).alias("null_rate"),
        "cardinality", F.coalesce(score.cast("double"), F.lit(0.0)).alias("candidate_key_score"))
    return stats.join(first_values(df, columns, order, examples), "column", "left")


def frame_profile(df: DataFrame, order: list[Column], samples: int = 5) -> DataFrame:
    """Null, present and distinct present counts, plus first values."""
    columns = df.columns
    counts = df.agg(F.count("*").alias("rows"), *[F.count(f"`{c}`").alias(f"p{i}") for i, c in enumerate(columns)])
    stats = counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(dict(df.dtypes)[c]).alias("dtype"),
                 (F.col("rows") - F.col(f"p{i}")).alias("null_count"), F.col(f"p{i}").alias("non_null_count"))
        for i, c in enumerate(columns)])))
    distinct = _pairs(df, columns).groupBy("column").agg(F.countDistinct("value").alias("unique_count"))
    return (stats.join(distinct, "column", "left")
            .join(first_values(df, columns, order, samples, blank=True), "column", "left"))


def quality_profile(df: DataFrame) -> DataFrame:
    """Rows, nulls, type and distinct values per column; null counts as a value."""
    columns = df.columns
    types = dict(df.dtypes)
    stats = _pairs(df, columns).groupBy("column").agg(
        F.count("*").alias("row_count"), F.count_if(F.col("value").isNull()).alias("null_count"),
        F.countDistinct("value").alias("_present"))
    dtype = F.create_map(*[F.lit(x) for c in columns for x in (c, types[c])])
    return stats.select(
        "column", "row_count", "null_count",
        (F.col("_present") + (F.col("null_count") > 0).cast("bigint")).alias("unique_count"),
        dtype[F.col("column")].alias("dtype"))


def typed_cells(df: DataFrame, row_idx: Column, types: dict[str, Column] | None = None) -> DataFrame:
    """Long form (col_idx, header, row_idx, value, type) of a frame's present cells.

    ``types`` overrides the type label of a column, for sources whose cells
    are typed one by one.
    """
    labels = {"string": "str", "bigint": "int", "int": "int", "double": "float", "boolean": "bool",
              "timestamp_ntz": "datetime", "timestamp": "datetime", "date": "date"}
    types = types or {}
    cells = [F.struct(F.lit(i + 1).alias("col_idx"), F.lit(c).alias("header"), row_idx.alias("row_idx"),
                      F.col(f"`{c}`").cast("string").alias("value"),
                      types.get(c, F.lit(labels.get(d, d))).alias("type"))
             for i, (c, d) in enumerate(df.dtypes)]
    return df.select(F.inline(F.array(*cells)))


def _end_rows(present: DataFrame, by_type: DataFrame, samples: int, ranges: int = 1024) -> DataFrame:
    """Cells in the row ranges that hold each column's first and last values.

    Counting rows per range finds those ranges without sorting the data. The
    joined frames have one row per column, and at most ``2 * samples`` ranges
    of each; AQE broadcasts them if they are small.
    """
    span = by_type.groupBy("col_idx").agg(F.min("seen").alias("_low"), F.max("last").alias("_high")).select(
        "col_idx", "_low", F.ceil((F.col("_high") - F.col("_low") + 1) / ranges).alias("_width"))
    placed = present.select("col_idx", "row_idx", "value").join(span, "col_idx").withColumn(
        "_range", F.floor((F.col("row_idx") - F.col("_low")) / F.col("_width")))
    counts = placed.groupBy("col_idx", "_range").agg(F.count("*").alias("_n"))
    w = W.partitionBy("col_idx").orderBy("_range")
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    after = F.coalesce(F.sum("_n").over(w.rowsBetween(1, W.unboundedFollowing)), F.lit(0))
    wanted = counts.withColumns({"_before": before, "_after": after}).where(
        (F.col("_before") < samples) | (F.col("_after") < samples)).select("col_idx", "_range")
    return placed.join(wanted, ["col_idx", "_range"]).select("col_idx", "row_idx", "value")


def column_summary(cells: DataFrame, samples: int = 8, categories: int = 15) -> DataFrame:
    """Per-column summary of typed cells: ends, types, distinct count, and values if they are few.

    ``samples`` first and last values are shown; values are listed if there are
    at most ``categories``, and counted in any case.
    """
    present = cells.where(F.col("value").isNotNull())
    row = F.when(F.col("value").isNotNull(), F.col("row_idx"))
    by_type = (cells.groupBy("col_idx", "header", "type")
               .agg(F.count("value").alias("n"), F.min(row).alias("seen"), F.max(row).alias("last")))
    kind = F.when(F.col("n") > 0, F.struct((-F.col("n")).alias("rank"), "seen", "type", "n"))
    types = by_type.groupBy("col_idx", "header").agg(
        F.sum("n").alias("non_empty_count"), F.array_sort(F.collect_list(kind)).alias("kinds"))
    top = F.try_element_at("kinds", F.lit(1))
    rest = F.expr("array_sort(transform(slice(kinds, 2, greatest(size(kinds), 1)), k -> struct(k.seen, k.type, k.n)))")
    minority = F.array_join(F.transform(
        rest, lambda k: F.format_string("%s (%d)", k["type"], k["n"])), ", ")
    types = types.select(
        "col_idx", "header", "non_empty_count", top["type"].alias("dominant_type"),
        F.when(F.size("kinds") > 1, F.concat(F.format_string(
            "%s in %d of %d cells; others: ", top["type"], top["n"], F.col("non_empty_count")), minority))
        .alias("type_inconsistencies"))

    near_ends = _end_rows(present, by_type, samples)

    def ends(direction: Column, name: str) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("col_idx").orderBy(direction))
        return (near_ends.withColumn("_r", rank)
                .where(F.col("_r") <= samples).groupBy("col_idx")
                .agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "value"))),
                                 lambda x: x["value"]).alias(name)))

    values = present.select("col_idx", "value").distinct()
    rank = F.row_number().over(W.partitionBy("col_idx").orderBy("value"))
    few = (values.withColumn("_r", rank).where(F.col("_r") <= categories + 1)
           .groupBy("col_idx").agg(F.array_sort(F.collect_list("value")).alias("v"))
           .select("col_idx", F.when(F.size("v") <= categories, F.col("v")).alias("distinct_values")))
    number = values.groupBy("col_idx").agg(F.count("*").alias("n_distinct"))
    return (types.join(ends(F.col("row_idx").asc(), "first_values"), "col_idx", "left")
            .join(ends(F.col("row_idx").desc(), "last_values"), "col_idx", "left")
            .join(few, "col_idx", "left").join(number, "col_idx", "left")
            .withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))
            .withColumn("last_values", F.when(F.col("non_empty_count") > samples, F.col("last_values"))))


def staging_metadata(table: str, df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Row count and column statistics of an output with its mapping ids.

    ``mapping``: target_column, mapping_column_id, sort_order; the first
    mapping of a column wins.
    """
    ids = mapping.groupBy("target_column").agg(
        F.min_by("mapping_column_id", "sort_order").alias("mapping_column_id"))
    return (quality_profile(df).withColumn("table_name", F.lit(table))
            .join(ids, F.col("column") == F.col("target_column"), "left").drop("target_column"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per value for each of the given columns."""
    return _pairs(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))


def result_summary(df: DataFrame, categories: list[str], measure: str) -> DataFrame:
    """Facts about a result as (fact, item, amount) rows: rows, nulls, values, total."""
    columns = df.columns
    total = F.sum(F.col(measure).cast("decimal(38,4)"))
    facts = df.agg(F.count("*").alias("rows"), total.alias("total"),
                   *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(columns)])

    def fact(kind: str, item: str, amount: Column) -> Column:
        return F.struct(F.lit(kind).alias("fact"), F.lit(item).alias("item"), amount.cast("double").alias("amount"))

    wide = facts.select(F.inline(F.array(
        fact("rows", "all", F.col("rows")), fact("total", measure, F.col("total")),
        *[fact("nulls", c, F.col(f"n{i}")) for i, c in enumerate(columns)])))
    counts = value_counts(df, categories).select(
        F.concat(F.lit("count "), "column").alias("fact"), F.col("value").alias("item"),
        F.col("n").cast("double").alias("amount"))
    return wide.unionByName(counts)

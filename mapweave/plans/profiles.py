"""Profiling aggregates (P1-P7) over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapweave.operators import profile as P
from mapweave.plans.registry import query


def _joined(df, *names):
    """Arrays as text, so that both engines hash the same values."""
    return df.withColumns({n: F.array_join(n, "|") for n in names})


_TYPED = """(SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_type = 'error' THEN 'anon' ELSE CAST(user_id AS VARCHAR) END AS "user",
 CAST(value AS VARCHAR) AS value, CAST(value > 5 AS VARCHAR) AS flag, CASE WHEN event_id < 0 THEN 'x' ELSE '' END AS none, ts, CAST(ts AS DATE) AS day,
 value AS raw FROM events)"""
_TEXT_TYPE = """
SELECT '{c}' AS "column", CASE WHEN count(v) = 0 THEN 'null' ELSE 'string' END AS inferred_type,
 CASE WHEN count(v) = 0 THEN 'string' WHEN bool_and(regexp_matches(v, '^(?i)(true|false)$')) THEN 'boolean' WHEN bool_and(regexp_matches(v, '^[+-]?[0-9]+$')
 AND TRY_CAST(v AS BIGINT) IS NOT NULL) THEN 'bigint' WHEN bool_and(regexp_matches(v, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')) THEN 'double'
 ELSE 'string' END AS load_type FROM (SELECT nullif("{c}", '') AS v FROM {src})"""
_NATIVE_TYPE = """
SELECT '{c}', CASE WHEN count({c}) = 0 THEN 'null' ELSE '{label}' END, CASE WHEN count({c}) = 0 THEN 'string' ELSE '{load}' END FROM {src}"""


@query("p01_type_inference", " UNION ALL ".join(
    [_TEXT_TYPE.format(c=c, src=_TYPED) for c in ("event_id", "user", "value", "flag", "none")]
    + [_NATIVE_TYPE.format(c=c, label=k, load=d, src=_TYPED) for c, k, d in (
        ("ts", "datetime", "string"), ("day", "date", "string"), ("raw", "number", "double"))]))
def _(t):
    return P.infer_types(t.events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.when(F.col("event_type") == "error", "anon").otherwise(F.col("user_id").cast("string")).alias("user"),
        F.col("value").cast("string").alias("value"), (F.col("value") > 5).cast("string").alias("flag"),
        F.when(F.col("event_id") < 0, "x").otherwise("").alias("none"), "ts", F.to_date("ts").alias("day"),
        F.col("value").alias("raw")))


_PROFILE_SRC = """(SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS status,
 nullif(o_custkey, 3) AS cust, o_orderpriority AS priority FROM orders)"""
_ORDER_COLS = [("o_orderkey", 1), ("status", 2), ("cust", 3), ("priority", 4)]


def _profile_src(t):
    return t.orders.select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("status"),
        F.nullif("o_custkey", F.lit(3)).alias("cust"), F.col("o_orderpriority").alias("priority"))


@query("p02_catalog_profile", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", {n} AS ordinal, count(*) - count(v) AS null_count,
 CAST((count(*) - count(v)) AS DOUBLE) / count(*) AS null_rate, count(DISTINCT v) AS cardinality,
 CAST(round_even(CAST(count(DISTINCT v) AS DOUBLE) / count(*), 4) AS DOUBLE) AS candidate_key_score,
 (SELECT string_agg(v, '|' ORDER BY o_orderkey) FROM (SELECT CAST({c} AS VARCHAR) AS v, o_orderkey FROM {_PROFILE_SRC}
  WHERE CAST({c} AS VARCHAR) <> '' ORDER BY o_orderkey LIMIT 5)) AS examples
FROM (SELECT nullif(CAST({c} AS VARCHAR), '') AS v FROM {_PROFILE_SRC})""" for c, n in _ORDER_COLS))
def _(t):
    return _joined(P.catalog_profile(_profile_src(t), [F.col("o_orderkey")]), "examples")


@query("p03_frame_profile", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", '{d}' AS dtype, count(*) - count({c}) AS null_count, count({c}) AS non_null_count,
 count(DISTINCT {c}) AS unique_count, (SELECT string_agg(v, '|' ORDER BY p_partkey) FROM (SELECT CAST({c} AS VARCHAR) AS v,
 p_partkey FROM part_n WHERE {c} IS NOT NULL ORDER BY p_partkey LIMIT 5)) AS examples FROM part_n"""
    for c, d in (("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_size", "int")))
    .join(("""WITH part_n AS (SELECT p_partkey, nullif(p_name, 'red widget') AS p_name, p_brand, nullif(p_size, 11) AS p_size FROM part)
 SELECT * FROM (""", ")")))
def _(t):
    part = t.part.select("p_partkey", F.nullif("p_name", F.lit("red widget")).alias("p_name"), "p_brand",
                         F.nullif("p_size", F.lit(11)).alias("p_size"))
    return _joined(P.frame_profile(part, [F.col("p_partkey")]), "examples")


_EVENTS_N = """(SELECT event_id, nullif(event_type, 'click') AS event_type,
 CASE WHEN value > 3 THEN value END AS value, user_id FROM events)"""
_QUALITY = " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) AS row_count, count(*) - count({c}) AS null_count,
 count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END AS unique_count, '{d}' AS dtype FROM {_EVENTS_N}"""
    for c, d in (("event_id", "bigint"), ("event_type", "string"), ("value", "double"), ("user_id", "bigint")))


def _events_n(t):
    return t.events.select("event_id", F.nullif("event_type", F.lit("click")).alias("event_type"),
                           F.when(F.col("value") > 3, F.col("value")).alias("value"), "user_id")


@query("p04_quality_profile", _QUALITY)
def _(t):
    return P.quality_profile(_events_n(t))


_CELLS = """WITH l AS (SELECT l_orderkey * 10000000000 + l_partkey * 1000 + l_linenumber * 100 + l_suppkey % 100 AS row_idx, * FROM lineitem),
cells AS (SELECT 1 AS col_idx, 'l_returnflag' AS header, row_idx, l_returnflag AS value, 'str' AS type FROM l
 UNION ALL SELECT 2, 'l_quantity', row_idx, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 'int' FROM l
 UNION ALL SELECT 3, 'l_discount', row_idx, CASE WHEN l_discount > 0 THEN CAST(l_discount AS VARCHAR) ELSE '0' END,
  CASE WHEN l_discount > 0 THEN 'float' ELSE 'int' END FROM l
 UNION ALL SELECT 4, 'note', row_idx, CASE WHEN l_tax > 0.05 THEN 'high' WHEN l_tax > 0.02 THEN '' END, 'str' FROM l
 UNION ALL SELECT 5, 'empty', row_idx, NULL, 'str' FROM l), p AS (SELECT * FROM cells WHERE value IS NOT NULL), """


@query("p05_column_summary", _CELLS + """
k AS (SELECT col_idx, type, count(*) AS n, min(row_idx) AS seen FROM p GROUP BY 1, 2),
k2 AS (SELECT *, row_number() OVER (PARTITION BY col_idx ORDER BY n DESC, seen) AS r, sum(n) OVER (PARTITION BY col_idx) AS t FROM k),
ty AS (SELECT col_idx, CAST(max(t) AS BIGINT) AS n, max(type) FILTER (WHERE r = 1) AS dominant,
 CASE WHEN count(*) > 1 THEN max(type) FILTER (WHERE r = 1) || ' in ' || max(n) FILTER (WHERE r = 1) || ' of ' || max(t)
 || ' cells; others: ' || string_agg(type || ' (' || n || ')', ', ' ORDER BY seen) FILTER (WHERE r > 1) END AS odd FROM k2 GROUP BY 1),
e AS (SELECT *, row_number() OVER (PARTITION BY col_idx ORDER BY row_idx) AS a,
 row_number() OVER (PARTITION BY col_idx ORDER BY row_idx DESC) AS z FROM p),
d AS (SELECT col_idx, count(*) AS nd, CASE WHEN count(*) <= 15 THEN string_agg(value, '|' ORDER BY value) END AS vals
 FROM (SELECT DISTINCT col_idx, value FROM p) GROUP BY 1)
SELECT h.col_idx, h.header, coalesce(ty.n, 0) AS non_empty_count, ty.dominant AS dominant_type, ty.odd AS type_inconsistencies,
 (SELECT string_agg(value, '|' ORDER BY row_idx) FROM e WHERE e.col_idx = h.col_idx AND a <= 8) AS first_values,
 CASE WHEN ty.n > 8 THEN (SELECT string_agg(value, '|' ORDER BY row_idx) FROM e WHERE e.col_idx = h.col_idx AND z <= 8) END AS last_values,
 d.vals AS distinct_values, coalesce(d.nd, 0) AS n_distinct
FROM (SELECT DISTINCT col_idx, header FROM cells) h LEFT JOIN ty USING (col_idx) LEFT JOIN d USING (col_idx)""")
def _(t):
    row = F.expr("l_orderkey * 10000000000 + l_partkey * 1000 + l_linenumber * 100 + l_suppkey % 100")
    lines = t.lineitem.withColumn("_row", row).select(
        "l_returnflag", F.col("l_quantity").cast("bigint").alias("l_quantity"),
        F.when(F.col("l_discount") > 0, F.col("l_discount").cast("string")).otherwise("0").alias("l_discount"),
        F.when(F.col("l_tax") > 0.05, "high").when(F.col("l_tax") > 0.02, "").alias("note"),
        F.lit(None).cast("string").alias("empty"), "_row")
    cells = P.typed_cells(lines, F.col("_row"), {
        "l_discount": F.when(F.col("l_discount") == "0", "int").otherwise("float")}).where("header <> '_row'")
    return _joined(P.column_summary(cells), "first_values", "last_values", "distinct_values")


@query("p06_staging_metadata", f"""
SELECT 'events' AS table_name, q.*, m.mapping_column_id FROM ({_QUALITY}) q LEFT JOIN
 (SELECT event_type AS target_column, 'm' || min(event_id) AS mapping_column_id FROM events GROUP BY 1 UNION ALL
  SELECT 'user_id', 'm' || min(event_id) FROM events WHERE user_id = 3 UNION ALL
  SELECT 'value', 'm' || min(event_id) FROM events WHERE user_id = 4) m ON q."column" = m.target_column""")
def _(t):
    mapping = t.events.select(
        F.when(F.col("user_id") == 3, "user_id").when(F.col("user_id") == 4, "value")
        .otherwise(F.col("event_type")).alias("target_column"),
        F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("mapping_column_id"),
        F.col("event_id").alias("sort_order"))
    return P.staging_metadata("events", _events_n(t), mapping)


@query("p07_result_summary", """
SELECT 'rows' AS fact, 'all' AS item, CAST(count(*) AS DOUBLE) AS amount FROM orders
UNION ALL SELECT 'total', 'o_totalprice', CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) FROM orders
UNION ALL SELECT 'nulls', c, CAST(0 AS DOUBLE) FROM (SELECT unnest(['o_orderkey','o_custkey','o_totalprice','o_orderdate','o_orderpriority']) AS c)
UNION ALL SELECT 'nulls', 'o_orderstatus', CAST(count(*) AS DOUBLE) FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'count o_orderstatus', nullif(o_orderstatus, 'P'), CAST(count(*) AS DOUBLE) FROM orders GROUP BY 2
UNION ALL SELECT 'count o_orderpriority', o_orderpriority, CAST(count(*) AS DOUBLE) FROM orders GROUP BY 2""")
def _(t):
    orders = t.orders.withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return P.result_summary(orders, ["o_orderstatus", "o_orderpriority"], "o_totalprice")

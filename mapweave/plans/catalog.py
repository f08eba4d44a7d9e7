"""Catalog resolution and mapping checks (C1-C8) over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapweave.operators import catalog as C
from mapweave.operators.nesting import nest
from mapweave.plans.registry import query
from mapweave.session import shared_dir
from mapweave.sources.versions import VersionedTable

# Catalog columns from part: tables of 20 columns, some sharing file and sheet.
# The texts are SQL that both engines run.
_I = "CAST(floor(p_partkey / 20) AS BIGINT)"
_COLUMNS = f"""SELECT concat('spec', CAST({_I} % 2 AS STRING)) AS scope, p_partkey AS pos,
 CASE WHEN {_I} % 11 = 3 THEN '' ELSE concat('f', CAST({_I} % 10 AS STRING), '.csv') END AS original_filename,
 CASE WHEN {_I} % 13 = 5 THEN NULL ELSE concat('Sheet', CAST({_I} % 7 AS STRING)) END AS display_name,
 concat('S', CAST({_I} % 3 AS STRING)) AS sheet_name, concat('t', CAST({_I} AS STRING)) AS source_table_id,
 concat('c', CAST(p_partkey AS STRING)) AS source_column_id,
 CASE WHEN {_I} % 5 > 0 THEN concat('raw', CAST({_I} AS STRING)) END AS raw_file_id,
 p_name AS column_name FROM part"""
_KEYED = f"""WITH cols AS ({_COLUMNS}), keyed AS (SELECT *, coalesce(nullif(original_filename, ''), 'unknown') || '::' ||
 coalesce(nullif(display_name, ''), nullif(sheet_name, ''), '') AS table_key FROM cols),
idx AS (SELECT scope, table_key, arg_max(source_table_id, pos) AS source_table_id, min(pos) AS place,
 arg_max(coalesce(display_name, '~'), pos) AS display_name FROM keyed GROUP BY 1, 2) """

# References from lineitem: exact keys, other case, display names, unknown names.
_REFS = f"""SELECT l_orderkey * 10000000000 + l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS ref_id,
 concat('spec', CAST(CAST(floor(l_partkey / 20) AS BIGINT) % 2 AS STRING)) AS scope,
 CASE WHEN l_linenumber <= 3 THEN concat('f', CAST(CAST(floor(l_partkey / 20) AS BIGINT) % 10 AS STRING), '.csv::Sheet',
  CAST(CAST(floor(l_partkey / 20) AS BIGINT) % 7 AS STRING))
  ELSE concat('SHEET', CAST(CAST(floor(l_partkey / 20) AS BIGINT) % 7 AS STRING)) END AS source_table,
 CASE WHEN l_linenumber = 1 THEN p_name WHEN l_linenumber <= 5 THEN upper(p_name)
  ELSE concat('no ', p_name) END AS source_column FROM lineitem JOIN part ON l_partkey = p_partkey"""


def _sql(t, text):
    for name in ("part", "lineitem", "orders", "customer", "nation", "region"):
        getattr(t, name).createOrReplaceTempView(name)
    return t.spark.sql(text)


@query("c01_composite_key_index", _KEYED + """
SELECT scope, table_key || '::' || column_name AS key, arg_max(source_table_id, pos) AS source_table_id,
 arg_max(source_column_id, pos) AS source_column_id FROM keyed GROUP BY 1, 2""")
def _(t):
    return C.column_index(_sql(t, _COLUMNS)).select("scope", "key", "source_table_id", "source_column_id")


@query("c02_tiered_resolution", _KEYED + f""", refs AS ({_REFS}),
exact AS (SELECT scope, table_key || '::' || column_name AS key, arg_max(source_column_id, pos) AS id FROM keyed GROUP BY 1, 2),
live AS (SELECT k.scope, i.table_key, i.place, lower(i.display_name) AS disp, k.pos, lower(k.column_name) AS col, k.source_column_id
 FROM keyed k JOIN idx i ON k.scope = i.scope AND k.source_table_id = i.source_table_id),
t2 AS (SELECT scope, table_key, col, arg_min(source_column_id, pos) AS id FROM live GROUP BY 1, 2, 3),
t3 AS (SELECT scope, disp, col, arg_min(source_column_id, place * 1000000000 + pos) AS id FROM live GROUP BY 1, 2, 3)
SELECT r.ref_id, CASE WHEN e.id IS NOT NULL THEN 1 WHEN t2.id IS NOT NULL THEN 2 WHEN t3.id IS NOT NULL THEN 3 END AS tier,
 coalesce(e.id, t2.id, t3.id) AS source_column_id, CASE WHEN e.id IS NULL AND t2.id IS NULL AND t3.id IS NULL THEN
 'source column ''' || source_column || ''' not found for key ''' || source_table || '''' END AS error
FROM refs r LEFT JOIN exact e ON r.scope = e.scope AND e.key = r.source_table || '::' || r.source_column
LEFT JOIN t2 ON r.scope = t2.scope AND r.source_table = t2.table_key AND lower(r.source_column) = t2.col
LEFT JOIN t3 ON r.scope = t3.scope AND lower(r.source_table) = t3.disp AND lower(r.source_column) = t3.col""")
def _(t):
    return (C.resolve_columns(_sql(t, _REFS), _sql(t, _COLUMNS))
            .select("ref_id", "tier", "source_column_id", "error"))


@query("c03_table_key_resolution", _KEYED + f""", refs AS ({_REFS}),
d AS (SELECT scope, lower(display_name) AS disp, arg_min(source_table_id, place) AS id FROM idx GROUP BY 1, 2)
SELECT r.ref_id, coalesce(i.source_table_id, d.id) AS source_table_id,
 CASE WHEN i.source_table_id IS NULL AND d.id IS NULL THEN '''' || source_table || ''' is not in the catalog' END AS error
FROM refs r LEFT JOIN idx i ON r.scope = i.scope AND r.source_table = i.table_key
LEFT JOIN d ON r.scope = d.scope AND lower(r.source_table) = d.disp""")
def _(t):
    refs = _sql(t, _REFS).withColumnRenamed("source_table", "table_key").drop("source_column")
    tables = _sql(t, _COLUMNS).groupBy(
        "scope", "source_table_id", "original_filename", "display_name", "sheet_name").agg(F.min("pos").alias("pos"))
    return C.resolve_tables(refs, tables).select("ref_id", "source_table_id", "error")


# Mappings from orders: ids into the catalog above, some of them broken.
_MAPPINGS = """SELECT o_orderkey AS mapping_id, concat('spec', CAST(CAST(floor(o_custkey / 20) AS BIGINT) % 2 AS STRING)) AS scope,
 'orders' AS target_table, concat('col', CAST(o_custkey % 40 AS STRING)) AS target_column,
 CASE WHEN o_orderkey % 23 = 0 THEN '' WHEN o_orderkey % 19 = 0 THEN 'tX' ELSE
  concat('t', CAST(CAST(floor(o_custkey / 20) AS BIGINT) AS STRING)) END AS source_table_id,
 CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN concat('c', CAST(o_custkey + 40 AS STRING))
  ELSE concat('c', CAST(o_custkey AS STRING)) END AS source_column_id,
 CASE WHEN o_orderkey % 11 = 0 THEN 'rawX' ELSE concat('raw', CAST(CAST(floor(o_custkey / 20) AS BIGINT) AS STRING)) END AS raw_file_id,
 CASE WHEN o_orderstatus = 'F' THEN concat('t', CAST(CAST(floor(o_custkey / 20) AS BIGINT) + o_orderkey % 2 AS STRING)) END AS lookup_source_table,
 CASE WHEN o_orderkey % 3 = 0 THEN 'red widget' ELSE '' END AS lookup_key, 'blue bolt' AS lookup_value,
 CASE WHEN o_orderstatus = 'O' THEN 't3' END AS aggregation_source_table, 'small ring' AS aggregation_group_key FROM orders"""
_CONTRACT = """SELECT DISTINCT 'orders' AS target_table, concat('col', CAST(c_custkey % 38 AS STRING)) AS target_column,
 c_custkey % 38 < 20 AS required FROM customer"""


@query("c04_referential_validation", f"""WITH cols AS ({_COLUMNS}), m AS ({_MAPPINGS}), k AS ({_CONTRACT}),
tb AS (SELECT scope, source_table_id AS id, arg_max(coalesce(raw_file_id, '~'), pos) AS raw FROM cols GROUP BY 1, 2),
e AS (SELECT mapping_id, CASE WHEN m.source_table_id = '' THEN 'source_table_id is missing'
 WHEN tb.id IS NULL THEN 'table ' || m.source_table_id || ' is not in the catalog'
 WHEN m.source_column_id IS NULL THEN 'source_column_id is missing'
 WHEN c.source_table_id IS NULL OR c.source_table_id <> m.source_table_id THEN 'column ' || m.source_column_id || ' does not belong to table ' || m.source_table_id
 WHEN tb.raw <> '~' AND tb.raw <> m.raw_file_id THEN 'raw file of column ' || m.source_column_id || ' differs from the catalog' END AS error
 FROM m LEFT JOIN tb ON m.scope = tb.scope AND m.source_table_id = tb.id
 LEFT JOIN cols c ON m.scope = c.scope AND m.source_column_id = c.source_column_id)
SELECT * FROM e WHERE error IS NOT NULL
UNION ALL SELECT mapping_id, 'target column not in target schema' FROM m WHERE target_column NOT IN (SELECT target_column FROM k)
UNION ALL SELECT mapping_id, 'table ' || lookup_source_table || ' is not in the catalog' FROM m WHERE lookup_source_table IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM tb WHERE tb.scope = m.scope AND tb.id = m.lookup_source_table)
UNION ALL SELECT mapping_id, label || ' ''' || name || ''' not in table ' || tid FROM (
 SELECT mapping_id, scope, 'lookup_key' AS label, lookup_key AS name, lookup_source_table AS tid FROM m WHERE lookup_key <> ''
 UNION ALL SELECT mapping_id, scope, 'lookup_value', lookup_value, lookup_source_table FROM m
 UNION ALL SELECT mapping_id, scope, 'aggregation_group_key', aggregation_group_key, aggregation_source_table FROM m) x
 WHERE tid IS NOT NULL AND EXISTS (SELECT 1 FROM tb WHERE tb.scope = x.scope AND tb.id = tid)
 AND NOT EXISTS (SELECT 1 FROM cols WHERE cols.scope = x.scope AND cols.source_table_id = tid AND column_name = name)
UNION ALL SELECT mapping_id, 'table ' || aggregation_source_table || ' is not in the catalog' FROM m WHERE aggregation_source_table IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM tb WHERE tb.scope = m.scope AND tb.id = m.aggregation_source_table)""")
def _(t):
    cols, m, contract = _sql(t, _COLUMNS), _sql(t, _MAPPINGS), _sql(t, _CONTRACT)
    lookup = {"lookup_key": "lookup_key", "lookup_value": "lookup_value"}
    group = {"aggregation_group_key": "aggregation_group_key"}
    return (C.check_sources(m, cols).unionByName(C.check_targets(m, contract))
            .unionByName(C.check_named_columns(m, cols, "lookup_source_table", lookup))
            .unionByName(C.check_named_columns(m, cols, "aggregation_source_table", group)))


_CONTRACT_PART = """SELECT p_brand AS target_table, concat('c', CAST(p_partkey AS STRING)) AS target_column, p_size % 2 = 0 AS required FROM part"""


@query("c05_target_coverage", f"""WITH k AS ({_CONTRACT_PART}), m AS (SELECT DISTINCT p_brand, l_partkey FROM lineitem JOIN part
 ON l_partkey = p_partkey WHERE l_returnflag = 'A' AND l_linenumber = 1)
SELECT target_table, target_column, CASE WHEN m.l_partkey IS NULL THEN 'missing_' ELSE 'covered_' END ||
 CASE WHEN required THEN 'required' ELSE 'optional' END AS coverage
FROM k LEFT JOIN m ON target_table = p_brand AND target_column = 'c' || l_partkey""")
def _(t):
    mapped = _sql(t, """SELECT p_brand AS target_table, concat('c', CAST(l_partkey AS STRING)) AS target_column
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A' AND l_linenumber = 1""")
    return C.coverage(mapped, _sql(t, _CONTRACT_PART))


_PROPOSAL = """SELECT p_partkey AS proposal_id, concat('{"mappings":[{"target_table":"parts","target_column":"c', CAST(p_partkey AS STRING),
 '","source_columns":[{"source_table":"', p_brand, '","source_column":"', p_name, '"}],"tests":["not_null",{"max":', CAST(p_size AS STRING),
 '}],"confidence":0.5},{"target_table":"parts"', CASE WHEN p_size % 2 = 0 THEN ',"target_column":"size"' ELSE '' END,
 ',"transformation_type":"lookup","lookup_key":"', p_type, '"}]}') AS proposal_json FROM part"""


@query("c06_proposal_rows", """
SELECT p_partkey AS proposal_id, 0 AS sort_order, 'parts' AS target_table, 'c' || p_partkey AS target_column, 'expression' AS transformation_type,
 '' AS transformation_logic, NULL AS lookup_key, p_brand || '.' || p_name AS sources, 'not_null|{"max":' || p_size || '}' AS tests,
 0.5::DOUBLE AS confidence, false AS rejected FROM part
UNION ALL SELECT p_partkey, 1, 'parts', CASE WHEN p_size % 2 = 0 THEN 'size' END, 'lookup', '', p_type, NULL, '', NULL, p_size % 2 = 1 FROM part""")
def _(t):
    rows = C.parse_proposals(_sql(t, _PROPOSAL))
    sources = F.array_join(F.transform("source_columns", lambda r: F.concat(
        r["source_table"], F.lit("."), r["source_column"])), "|")
    return rows.select("proposal_id", "sort_order", "target_table", "target_column", "transformation_type",
                       "transformation_logic", "lookup_key", sources.alias("sources"),
                       F.array_join("tests", "|").alias("tests"), "confidence", "rejected")


@query("c07_replace_spec_columns", """
SELECT c_nationkey AS spec_id, c_name AS target_column, CAST(c_custkey AS BIGINT) AS sort_order FROM customer WHERE c_nationkey % 5 > 0
UNION ALL SELECT c_nationkey, 'new ' || c_name, c_custkey FROM customer WHERE c_nationkey % 5 = 0 AND c_acctbal > 0""")
def _(t):
    path = shared_dir(t.spark, "spec-columns")
    rows = t.customer.select(F.col("c_nationkey").alias("spec_id"), F.col("c_name").alias("target_column"),
                             F.col("c_custkey").alias("sort_order"))
    C.replace_spec_columns(rows, path)
    fresh = t.customer.where("c_nationkey % 5 = 0 AND c_acctbal > 0").select(
        F.col("c_nationkey").alias("spec_id"), F.concat(F.lit("new "), "c_name").alias("target_column"),
        F.col("c_custkey").alias("sort_order"))
    C.replace_spec_columns(fresh, path)
    return t.spark.read.schema("target_column string, sort_order bigint, spec_id int").parquet(path)


@query("c07_atomic_replace", """
SELECT c_nationkey AS spec_id, c_name AS target_column, CAST(c_custkey AS BIGINT) AS sort_order FROM customer WHERE c_nationkey % 5 > 0
UNION ALL SELECT c_nationkey, 'new ' || c_name, c_custkey FROM customer WHERE c_nationkey % 5 = 0""")
def _(t):
    """The columns of a fifth of all specs replaced in one step that no reader sees in part."""
    rows = t.customer.select(F.col("c_nationkey").alias("spec_id"), F.col("c_name").alias("target_column"),
                             F.col("c_custkey").alias("sort_order"))
    table = VersionedTable.create(rows, shared_dir(t.spark, "spec-versions"), "spec_id", 8)
    fresh = rows.where("spec_id % 5 = 0").withColumn("target_column", F.concat(F.lit("new "), "target_column"))
    table.replace(fresh)
    return table.read()


@query("c08_spec_projection", """
SELECT c_custkey AS spec_id, c_name AS client, slice_no, any_value(n) AS n_items,
 coalesce(string_agg(o_orderkey || ':' || o_orderstatus, '|' ORDER BY o_orderkey), '') AS columns
FROM (SELECT *, (row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1) // 6 AS slice_no, count(o_orderkey) OVER (PARTITION BY c_custkey) AS n
 FROM customer LEFT JOIN orders ON c_custkey = o_custkey) GROUP BY 1, 2, 3""")
def _(t):
    children = t.orders.select(F.col("o_custkey").alias("spec_id"), "o_orderkey",
                               F.concat_ws(":", "o_orderkey", "o_orderstatus").alias("label"))
    nested = nest(children, ["spec_id"], "o_orderkey", ["label"], "columns", slice_rows=6)
    text = F.array_join(F.transform("columns", lambda c: c["label"]), "|")
    return (t.customer.select(F.col("c_custkey").alias("spec_id"), F.col("c_name").alias("client"))
            .join(nested, "spec_id", "left")
            .select("spec_id", "client", F.coalesce("slice_no", F.lit(0)).alias("slice_no"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
                    F.coalesce(text, F.lit("")).alias("columns")))

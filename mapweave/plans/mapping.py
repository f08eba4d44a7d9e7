"""Mapping execution (D1-D11) over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapweave.functions.scalar import register_mapping_functions
from mapweave.operators import heavy
from mapweave.operators import mapping as M
from mapweave.plans.registry import query
from mapweave.schemas import MappingColumn as MC
from mapweave.schemas import TargetColumn as TC
from mapweave.schemas import TargetTable


def _expr(table, target, source, column, text=None, n=0):
    return MC(table, target, source_columns=((source, column),), expression=text, sort_order=n)


@query("d01_base_source_choice", """
SELECT l_orderkey AS spec_id, l_returnflag AS target_table,
 coalesce(arg_min(CASE WHEN l_linenumber % 3 > 0 THEN 'supplier_' || l_suppkey || '.csv' END,
  CASE WHEN l_linenumber % 3 > 0 THEN l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey END), l_returnflag) AS base_source
FROM lineitem GROUP BY l_orderkey, l_returnflag""")
def _(t):
    has = F.col("l_linenumber") % 3 > 0
    return M.base_tables(t.lineitem.select(
        F.col("l_orderkey").alias("spec_id"), F.col("l_returnflag").alias("target_table"),
        F.expr("l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey").alias("sort_order"),
        F.when(has, F.concat(F.lit("supplier_"), F.col("l_suppkey").cast("string"), F.lit(".csv")))
        .alias("source_table")))


@query("d02_filter", """
SELECT o_orderkey AS order_id FROM orders
WHERE NOT starts_with(CAST(o_orderkey AS VARCHAR), '99') AND nullif(o_orderstatus, 'P') <> 'F'""")
def _(t):
    spec = [
        MC("orders", "_no_tests", "filter", filter_expression="NOT startswith(cast(o_orderkey AS string), '99')"),
        MC("orders", "_open", "filter", filter_expression="nullif(o_orderstatus, 'P') <> 'F'", sort_order=5),
        _expr("orders", "order_id", "orders", "o_orderkey", n=1),
    ]
    return M.apply_spec(spec, {"orders": t.orders})["orders"]


@query("d03_expression_columns", """
SELECT l_orderkey AS order_id, l_linenumber AS line, round(l_quantity * l_extendedprice, 4) AS gross,
 round(round(l_quantity * l_extendedprice, 4) * (1 - l_discount), 4) AS net,
 l_quantity * 2 AS l_quantity, l_quantity * 2 + 1 AS after FROM lineitem""")
def _(t):
    s = "lineitem"
    spec = [
        _expr("lines", "order_id", s, "l_orderkey", n=0), _expr("lines", "line", s, "l_linenumber", n=1),
        _expr("lines", "gross", s, "l_quantity", "round(l_quantity * l_extendedprice, 4)", 2),
        _expr("lines", "net", s, "l_discount", "round(gross * (1 - l_discount), 4)", 3),
        _expr("lines", "l_quantity", s, "l_quantity", "l_quantity * 2", 4),
        _expr("lines", "after", s, "l_quantity", "l_quantity + 1", 5),
    ]
    return M.apply_spec(spec, {s: t.lineitem})["lines"]


@query("d04_direct_map", "SELECT p_partkey AS sku, p_name AS product_name, p_type AS category FROM part")
def _(t):
    spec = [_expr("products", "sku", "part", "p_partkey", n=0),
            _expr("products", "product_name", "part", "p_name", n=1),
            _expr("products", "category", "part", "p_type", n=2)]
    return M.apply_spec(spec, {"part": t.part})["products"]


@query("d05_null_column", "SELECT s_suppkey AS supplier_id, CAST(NULL AS DOUBLE) AS score FROM supplier")
def _(t):
    spec = [_expr("suppliers", "supplier_id", "supplier", "s_suppkey"), MC("suppliers", "score", sort_order=1)]
    contract = TargetTable("suppliers", (TC("supplier_id", "Int64"), TC("score", "Float64")))
    return M.apply_spec(spec, {"supplier": t.supplier}, [contract])["suppliers"]


@query("d06_lookup_fan_out", """
SELECT o_orderkey AS order_id, c.name AS customer FROM orders
LEFT JOIN (SELECT DISTINCT nullif(c_custkey, 7) AS k, name FROM (SELECT c_custkey, c_name AS name FROM customer
 UNION ALL SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey, 'alias ' || c_name FROM customer
 WHERE c_mktsegment = 'BUILDING')) c ON o_custkey = c.k""")
def _(t):
    c = t.customer.select(F.nullif(F.col("c_custkey"), F.lit(7)).alias("k"), F.col("c_name").alias("name"),
                          "c_mktsegment")
    names = c.unionByName(c).unionByName(
        c.where("c_mktsegment = 'BUILDING'").withColumn("name", F.concat(F.lit("alias "), F.col("name"))))
    spec = [_expr("orders", "order_id", "orders", "o_orderkey"),
            MC("orders", "customer", "lookup", (("orders", "o_custkey"),), lookup_table="names",
               lookup_key="k", lookup_value="name", sort_order=1)]
    return M.apply_spec(spec, {"orders": t.orders, "names": names})["orders"]


@query("d06_duplicate_lookup_keys", """
SELECT p_name, count(DISTINCT p_brand) AS n_values FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1""")
def _(t):
    return M.duplicate_lookup_keys(t.part, "p_name", "p_brand")


@query("d07_aggregation_join", """
SELECT c_custkey AS customer_id, CAST(a.total AS DOUBLE) AS total, a.n_orders, a.last_status FROM customer
LEFT JOIN (SELECT o_custkey, coalesce(sum(CAST(o_totalprice AS DECIMAL(18,4))), 0) AS total, count(*) AS n_orders,
 arg_max(o_orderstatus, o_orderkey) AS last_status FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey) a
ON c_custkey = a.o_custkey""")
def _(t):
    def agg(target, text, n):
        return MC("customers", target, "aggregation", (("customer", "c_custkey"),), aggregation_table="orders",
                  aggregation_key="o_custkey", aggregation_expression=text, sort_order=n)

    spec = [_expr("customers", "customer_id", "customer", "c_custkey"),
            agg("total", "coalesce(sum(cast(o_totalprice AS decimal(18,4))), 0)", 1),
            agg("n_orders", "count(*)", 2), agg("last_status", "max_by(o_orderstatus, o_orderkey)", 3)]
    contract = TargetTable("customers", (TC("total", "Float64"),))
    sources = {"customer": t.customer, "orders": t.orders.where("o_orderstatus <> 'P'")}
    return M.apply_spec(spec, sources, [contract])["customers"]


@query("d07_hot_key_join", """
SELECT l_orderkey, l_linenumber, a.n, CAST(a.total AS DOUBLE) AS total FROM lineitem LEFT JOIN (SELECT k, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,4))) AS total
 FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS k, o_totalprice FROM orders) GROUP BY k) a
 ON CASE WHEN l_linenumber IN (1, 2) THEN 0 WHEN l_linenumber = 3 THEN NULL ELSE l_suppkey END = a.k""")
def _(t):
    """Line items of which a third share one key and others have none, with orders grouped by a hot key."""
    base = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "CASE WHEN l_linenumber IN (1, 2) THEN 0 WHEN l_linenumber = 3 THEN NULL ELSE l_suppkey END AS k")
    orders = t.orders.selectExpr("CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS k", "o_totalprice")
    joined = M.aggregate_join(base, orders, "k", "k", {"n": "count(*)", "total": "cast(sum(cast(o_totalprice AS decimal(18,4))) AS double)"}, hot_rows=1000)
    return joined.select("l_orderkey", "l_linenumber", "n", "total")


@query("d07_hot_keys", """WITH k AS (SELECT user_id % 50 AS k, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1
 UNION ALL SELECT -1, count(*) FROM events WHERE event_id % 2 = 1)
SELECT k, n AS rows FROM k WHERE n > (SELECT count(*) // 8 FROM events)""")
def _(t):
    """Keys with over an eighth of the events, from the merged sketches of two parts (exact here: fewer keys than counters)."""
    keys = t.events.selectExpr("event_id % 2 AS part", "CASE WHEN event_id % 2 = 1 THEN -1 ELSE user_id % 50 END AS k")
    parts = [heavy.sketch(keys.where(F.col("part") == p), F.col("k")) for p in (0, 1)]
    named = heavy.hot_keys(heavy.merged(parts[0].union(parts[1])), hot_rows=0)
    share = t.events.agg(F.floor(F.count("*") / 8).alias("share"))
    labels = keys.select("k", F.xxhash64("k").alias("key_hash")).distinct()
    return (labels.join(named, "key_hash").join(F.broadcast(share), F.col("rows") > F.col("share")).select("k", "rows"))


@query("d08_final_projection", "SELECT l_shipdate AS shipped, l_orderkey AS order_id FROM lineitem WHERE l_tax > 0.04")
def _(t):
    spec = [_expr("ship", "order_id", "lineitem", "l_orderkey", n=2),
            _expr("ship", "shipped", "lineitem", "l_shipdate", n=1),
            MC("ship", "_taxed", "filter", (("lineitem", "l_tax"),), filter_expression="l_tax > 0.04", sort_order=9)]
    return M.apply_spec(spec, {"lineitem": t.lineitem})["ship"]


@query("d09_dtype_enforcement", """
SELECT event_id, CASE WHEN event_type = 'click' THEN NULL ELSE user_id END AS user_id, CAST(value AS DOUBLE) AS amount,
 CAST(ts AS DATE) AS day, CASE WHEN event_type = 'view' THEN NULL ELSE CAST(ts AS DATE) END AS text_day,
 date_trunc('second', ts) AS at, CAST(user_id AS VARCHAR) AS label, value AS untouched,
 CASE WHEN user_id BETWEEN 0 AND 65535 THEN CAST(user_id AS INTEGER) END AS small FROM events""")
def _(t):
    raw = t.events.select(
        "event_id", F.when(F.col("event_type") == "click", "n/a").otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.col("value").cast("string").alias("amount"), F.col("ts").alias("day"),
        F.when(F.col("event_type") == "view", "tomorrow").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("text_day"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.col("user_id").alias("label"),
        F.col("value").alias("untouched"), F.col("user_id").alias("small"))
    return M.enforce_dtypes(raw, TargetTable("events", (
        TC("event_id", "Int64"), TC("user_id", "Int64"), TC("amount", "Float64"), TC("day", "Date"),
        TC("text_day", "Date"), TC("at", "Datetime"), TC("label", "String"), TC("untouched", "Struct"),
        TC("small", "UInt16"), TC("absent", "Int64"))))


RETAIL_SCHEMA = (
    TargetTable("customers", (
        TC("customer_id", "Int64", True, True), TC("customer_name", "String", True), TC("nation", "String"),
        TC("segment", "String", allowed_values=("Construction", "HOUSEHOLD", "FURNITURE")),
        TC("total_revenue", "Float64"), TC("order_count", "Int64"))),
    TargetTable("orders", (
        TC("order_id", "Int64", True), TC("customer_id", "Int64", True), TC("product_name", "String"),
        TC("quantity", "Int64"), TC("unit_price", "Float64"), TC("order_date", "Date"),
        TC("line_total", "Float64"))),
)


def retail_spec():
    """Customers and order lines of the retail client, on the driver tables."""
    c, o = "customers", "orders"
    key = (("customer", "c_custkey"),)
    return [
        MC(c, "_credit", "filter", (("customer", "c_acctbal"),), filter_expression="c_acctbal > 0", sort_order=0),
        _expr(c, "customer_id", "customer", "c_custkey", n=1),
        _expr(c, "customer_name", "customer", "c_name", "titlecase(strip_chars(c_name))", 2),
        MC(c, "nation", "lookup", (("customer", "c_nationkey"),), lookup_table="nation", lookup_key="n_nationkey",
           lookup_value="n_name", sort_order=3),
        _expr(c, "segment", "customer", "c_mktsegment",
              "CASE c_mktsegment WHEN 'BUILDING' THEN 'Construction' ELSE c_mktsegment END", 4),
        MC(c, "total_revenue", "aggregation", key, aggregation_table="orders", aggregation_key="o_custkey",
           aggregation_expression="coalesce(sum(cast(o_totalprice AS decimal(18,4))), 0)", sort_order=5),
        MC(c, "order_count", "aggregation", key, aggregation_table="orders", aggregation_key="o_custkey",
           aggregation_expression="count(*)", tests=("positive",), sort_order=6),
        MC(o, "_kept", "filter", (("lineitem", "l_returnflag"),), filter_expression="l_returnflag <> 'R'", sort_order=0),
        _expr(o, "order_id", "lineitem", "l_orderkey", n=1),
        MC(o, "customer_id", "lookup", (("lineitem", "l_orderkey"),), lookup_table="orders", lookup_key="o_orderkey",
           lookup_value="o_custkey", sort_order=2),
        MC(o, "product_name", "lookup", (("lineitem", "l_partkey"),), lookup_table="part", lookup_key="p_partkey",
           lookup_value="p_name", sort_order=3),
        _expr(o, "quantity", "lineitem", "l_quantity", n=4),
        _expr(o, "unit_price", "lineitem", "l_extendedprice", n=5),
        _expr(o, "order_date", "lineitem", "l_shipdate", "date_format(l_shipdate, 'yyyy-MM-dd')", 6),
        _expr(o, "line_total", "lineitem", "l_quantity", "round(l_quantity * l_extendedprice, 2)", 7),
    ]


def retail_sources(t):
    return {"customer": t.customer, "orders": t.orders, "nation": t.nation, "part": t.part, "lineitem": t.lineitem}


@query("d10_multi_table_run", """
SELECT 'customers' AS target_table, c_custkey AS customer_id, 'Customer#' || substring(c_name, 10) AS customer_name,
 n_name AS nation, CASE c_mktsegment WHEN 'BUILDING' THEN 'Construction' ELSE c_mktsegment END AS segment,
 CAST(a.total AS DOUBLE) AS total_revenue, a.n AS order_count, CAST(NULL AS BIGINT) AS order_id,
 CAST(NULL AS VARCHAR) AS product_name, CAST(NULL AS BIGINT) AS quantity, CAST(NULL AS DOUBLE) AS unit_price,
 CAST(NULL AS DATE) AS order_date, CAST(NULL AS DOUBLE) AS line_total
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,4))) AS total, count(*) AS n FROM orders GROUP BY 1) a
 ON o_custkey = c_custkey WHERE c_acctbal > 0
UNION ALL
SELECT 'orders', o_custkey, NULL, NULL, NULL, NULL, NULL, l_orderkey, p_name, CAST(l_quantity AS BIGINT), l_extendedprice,
 CAST(l_shipdate AS DATE), round(l_quantity * l_extendedprice, 2)
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
WHERE l_returnflag <> 'R'""")
def _(t):
    register_mapping_functions(t.spark)
    out = M.apply_spec(retail_spec(), retail_sources(t), RETAIL_SCHEMA)
    tagged = [df.withColumn("target_table", F.lit(name)) for name, df in out.items()]
    return tagged[0].unionByName(tagged[1], allowMissingColumns=True)


@query("d11_chained_mapping", """
SELECT coalesce(r.r_name, 'EUROPE') AS region, c_mktsegment || '-' || n.n_name || '-' ||
 coalesce(r.r_name, 'EUROPE') || '-' || CAST(c_custkey AS VARCHAR) AS submission_id, n.n_name AS site
FROM customer LEFT JOIN (SELECT DISTINCT n_nationkey, n_name, nullif(n_regionkey, 2) AS rk FROM nation) n
 ON c_nationkey = n.n_nationkey LEFT JOIN region r ON n.rk = r.r_regionkey""")
def _(t):
    k = (("customer", "c_nationkey"),)
    nation = t.nation.withColumn("n_regionkey", F.nullif(F.col("n_regionkey"), F.lit(2)))
    spec = [
        MC("sub", "site", "lookup", k, lookup_table="nation", lookup_key="n_nationkey", lookup_value="n_name", sort_order=0),
        MC("sub", "_rk", "lookup", k, lookup_table="nation", lookup_key="n_nationkey", lookup_value="n_regionkey", sort_order=1),
        MC("sub", "region", "lookup", (("customer", "_rk"),), lookup_table="region", lookup_key="r_regionkey",
           lookup_value="r_name", sort_order=2),
        _expr("sub", "region", "customer", "c_custkey", "coalesce(region, 'EUROPE')", 3),
        _expr("sub", "submission_id", "customer", "c_custkey",
              "concat(c_mktsegment, '-', site, '-', region, '-', cast(c_custkey AS string))", 4),
    ]
    sources = {"customer": t.customer, "nation": nation, "region": t.region}
    return M.apply_spec(spec, sources)["sub"].drop("_rk")

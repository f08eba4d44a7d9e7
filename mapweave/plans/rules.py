"""Validation rules (V1-V8) over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapweave.functions.scalar import register_mapping_functions
from mapweave.operators import mapping as M
from mapweave.operators import rules as R
from mapweave.plans.mapping import RETAIL_SCHEMA, retail_sources, retail_spec
from mapweave.plans.registry import query


@query("v01_rule_building", """
WITH s AS (SELECT p_brand AS target_table, 'c' || p_partkey AS target_column, p_size % 2 = 0 AS required,
 p_size % 3 = 0 AS "unique", CASE WHEN p_partkey % 5 = 0 THEN ['positive', p_name || ' > 0'] WHEN p_partkey % 5 = 1
 THEN ['not_null'] ELSE [] END AS tests, p_partkey % 7 > 0 AS declared FROM part),
r AS (SELECT target_table, target_column, 'not_null' AS test, 'error' AS severity FROM s WHERE declared AND required
 UNION ALL SELECT target_table, target_column, 'unique', 'error' FROM s WHERE declared AND "unique"
 UNION ALL SELECT target_table, target_column, unnest(tests), 'warning' FROM s)
SELECT *, target_table || '.' || target_column || '.' || test AS test_name FROM r""")
def _(t):
    spec = t.part.select(
        F.col("p_brand").alias("target_table"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("target_column"),
        F.when(F.col("p_partkey") % 5 == 0, F.array(F.lit("positive"), F.concat("p_name", F.lit(" > 0"))))
        .when(F.col("p_partkey") % 5 == 1, F.array(F.lit("not_null"))).alias("tests"))
    contract = t.part.where("p_partkey % 7 > 0").select(
        F.col("p_brand").alias("target_table"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("target_column"),
        (F.col("p_size") % 2 == 0).alias("required"), (F.col("p_size") % 3 == 0).alias("unique"))
    return R.build_rules(spec, contract)


def _orders(t):
    """Orders with nulls and repeated values made."""
    return t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), "o_custkey",
                           F.nullif("o_orderkey", F.lit(5)).alias("one_null"),
                           F.when(F.col("o_orderkey") > 9, F.col("o_orderkey")).alias("many_nulls"),
                           F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("amount"))


_ORDERS = """WITH o AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, o_custkey, nullif(o_orderkey, 5) AS one_null,
 CASE WHEN o_orderkey > 9 THEN o_orderkey END AS many_nulls,
 CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS amount FROM orders) """


@query("v02_not_null", _ORDERS + """
SELECT 'orders.o_orderkey.not_null' AS test_name, 'error' AS severity, count(*) = count(o_orderkey) AS passed,
 CAST(NULL AS VARCHAR) AS details FROM o
UNION ALL SELECT 'orders.status.not_null', 'warning', count(*) = count(status), NULL FROM o""")
def _(t):
    return R.run_rules(_orders(t), [R.Rule("orders", "o_orderkey", "not_null", "error"),
                                    R.Rule("orders", "status", "not_null", "warning")])


@query("v03_unique", _ORDERS + """
SELECT 'orders.' || c || '.unique' AS test_name, 'error' AS severity, ok AS passed, CAST(NULL AS VARCHAR) AS details FROM (
 SELECT 'o_orderkey' AS c, max(n) <= 1 AS ok FROM (SELECT count(*) AS n FROM o GROUP BY o_orderkey)
 UNION ALL SELECT 'one_null', max(n) <= 1 FROM (SELECT count(*) AS n FROM o GROUP BY one_null)
 UNION ALL SELECT 'many_nulls', max(n) <= 1 FROM (SELECT count(*) AS n FROM o GROUP BY many_nulls)
 UNION ALL SELECT 'o_custkey', max(n) <= 1 FROM (SELECT count(*) AS n FROM o GROUP BY o_custkey))""")
def _(t):
    cols = ("o_orderkey", "one_null", "many_nulls", "o_custkey")
    return R.run_rules(_orders(t), [R.Rule("orders", c, "unique", "error") for c in cols])


@query("v03_unique_violations", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 2 THEN l_orderkey * 10 + l_linenumber END AS k FROM lineitem
WHERE CASE WHEN l_linenumber > 2 THEN l_orderkey * 10 + l_linenumber END IS NULL OR l_orderkey * 10 + l_linenumber IN
 (SELECT l_orderkey * 10 + l_linenumber FROM lineitem GROUP BY 1 HAVING count(*) > 1)""")
def _(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", F.when(
        F.col("l_linenumber") > 2, F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return R.violations(lines, R.Rule("lines", "k", "unique", "error"))


@query("v04_positive", """
SELECT 'lines.l_quantity.positive' AS test_name, 'warning' AS severity, coalesce(bool_and(l_quantity > 0), true) AS passed,
 CAST(NULL AS VARCHAR) AS details FROM lineitem
UNION ALL SELECT 'lines.tax.positive', 'warning', coalesce(bool_and(nullif(l_tax, 0) > 0), true), NULL FROM lineitem
UNION ALL SELECT 'lines.l_tax.positive', 'warning', coalesce(bool_and(l_tax > 0), true), NULL FROM lineitem""")
def _(t):
    lines = t.lineitem.withColumn("tax", F.nullif(F.col("l_tax"), F.lit(0.0)))
    return R.run_rules(lines, [R.Rule("lines", c, "positive", "warning") for c in ("l_quantity", "tax", "l_tax")])


@query("v05_custom_predicate", _ORDERS + """
SELECT 'orders.amount.amount < 600000' AS test_name, 'warning' AS severity, coalesce(bool_and(amount < 600000), true) AS passed,
 false AS broken FROM o
UNION ALL SELECT 'orders.status.status IN (''F'')', 'warning', coalesce(bool_and(status IN ('F')), true), false FROM o
UNION ALL SELECT 'orders.amount.avg(amount) > 1000', 'warning', avg(amount) > 1000, false FROM o
UNION ALL SELECT 'orders.amount.no_such_column > 1', 'warning', false, true
UNION ALL SELECT 'orders.amount.amount >', 'warning', false, true
UNION ALL SELECT 'orders.absent.not_null', 'warning', false, true""")
def _(t):
    tests = [("amount", "amount < 600000"), ("status", "status IN ('F')"), ("amount", "avg(amount) > 1000"),
             ("amount", "no_such_column > 1"), ("amount", "amount >"), ("absent", "not_null")]
    return (R.run_rules(_orders(t), [R.Rule("orders", c, x, "warning") for c, x in tests])
            .select("test_name", "severity", "passed", F.col("details").isNotNull().alias("broken")))


_RETAIL = """WITH c AS (SELECT c_custkey AS customer_id, 'x' || c_name AS customer_name,
 CASE c_mktsegment WHEN 'BUILDING' THEN 'Construction' ELSE c_mktsegment END AS segment, a.n AS order_count
 FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) a ON o_custkey = c_custkey WHERE c_acctbal > 0),
o AS (SELECT l_orderkey AS order_id, o_custkey AS customer_id FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
 WHERE l_returnflag <> 'R') """


@query("v06_rule_run", _RETAIL + """
SELECT 'customers.customer_id.not_null' AS test_name, 'error' AS severity, count(*) = count(customer_id) AS passed FROM c
UNION ALL SELECT 'customers.customer_id.unique', 'error', count(*) = count(DISTINCT customer_id) FROM c
UNION ALL SELECT 'customers.customer_name.not_null', 'error', count(*) = count(customer_name) FROM c
UNION ALL SELECT 'customers.segment.allowed_values', 'warning', bool_and(segment IN ('Construction', 'HOUSEHOLD', 'FURNITURE')) FROM c
UNION ALL SELECT 'customers.order_count.positive', 'warning', coalesce(bool_and(order_count > 0), true) FROM c
UNION ALL SELECT 'orders.order_id.not_null', 'error', count(*) = count(order_id) FROM o
UNION ALL SELECT 'orders.customer_id.not_null', 'error', count(*) = count(customer_id) FROM o""")
def _(t):
    register_mapping_functions(t.spark)
    spec = retail_spec()
    rules = R.rules_of(spec, RETAIL_SCHEMA)
    out = M.apply_spec(spec, retail_sources(t), RETAIL_SCHEMA)
    parts = [R.run_rules(df, [r for r in rules if r.table == name]) for name, df in out.items()]
    return parts[0].unionByName(parts[1]).drop("details")


@query("v07_allowed_values", """
SELECT c_custkey, c_mktsegment FROM customer WHERE nullif(c_mktsegment, 'MACHINERY') NOT IN ('HOUSEHOLD', 'FURNITURE')""")
def _(t):
    segments = t.customer.select("c_custkey", "c_mktsegment",
                                 F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("segment"))
    rule = R.Rule("customers", "segment", "allowed_values", "warning", ("HOUSEHOLD", "FURNITURE"))
    return R.violations(segments, rule).drop("segment")


@query("v08_failure_summary", """
SELECT l_suppkey AS run_id, CASE WHEN l_returnflag = 'A' THEN 'error' ELSE 'warning' END AS severity,
 count(*) FILTER (WHERE l_tax > 0) AS passed, count(*) FILTER (WHERE NOT l_tax > 0) AS failed
FROM lineitem GROUP BY 1, 2""")
def _(t):
    results = t.lineitem.select(
        F.col("l_suppkey").alias("run_id"), (F.col("l_tax") > 0).alias("passed"),
        F.when(F.col("l_returnflag") == "A", "error").otherwise("warning").alias("severity"))
    return R.summarise(results, "run_id")

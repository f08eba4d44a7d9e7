"""Mapping-language functions (F1-F23) over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapweave.functions import scalar as S
from mapweave.plans.registry import query


@query("f01_col_lit_null", """
SELECT c_custkey, c_name AS name, 'retail' AS client, CAST(NULL AS VARCHAR) AS note FROM customer""")
def _(t):
    return t.customer.select("c_custkey", F.col("c_name").alias("name"), F.lit("retail").alias("client"),
                             F.lit(None).cast("string").alias("note"))


@query("f02_when_chain", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Finished' WHEN o_orderstatus = 'O' THEN 'Open'
 ELSE NULL END AS state,
 CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS band
FROM orders""")
def _(t):
    price = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "Finished")
        .when(F.col("o_orderstatus") == "O", "Open").otherwise(F.lit(None)).alias("state"),
        F.when(price > 300000, "big").when(price > 100000, "mid").otherwise("small").alias("band"))


@query("f03_coalesce", """
SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), CASE WHEN c_acctbal > 0 THEN 'in credit' END,
 'none') AS segment FROM customer""")
def _(t):
    return t.customer.select("c_custkey", F.expr(
        "coalesce(nullif(c_mktsegment, 'BUILDING'), CASE WHEN c_acctbal > 0 THEN 'in credit' END, 'none')"
    ).alias("segment"))


@query("f04_concat_null_rule", """
SELECT c_custkey, c_name || '-' || nullif(c_mktsegment, 'MACHINERY') || '-' || CAST(c_nationkey AS VARCHAR)
 AS site_key FROM customer""")
def _(t):
    return t.customer.select("c_custkey", S.concat_all(
        F.col("c_name"), "-", F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")), "-",
        F.col("c_nationkey").cast("string")).alias("site_key"))


@query("f05_cast_or_null", """
SELECT event_id, TRY_CAST(nullif(regexp_extract(props, '([0-9]+)', 1), '') AS BIGINT) AS k,
 TRY_CAST(CASE WHEN event_type = 'click' THEN 'n/a' ELSE CAST(event_id AS VARCHAR) END AS BIGINT) AS n,
 TRY_CAST(CASE WHEN event_type = 'view' THEN '1,5' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS v
FROM events""")
def _(t):
    return t.events.select(
        "event_id",
        S.cast_or_null(F.regexp_extract("props", "([0-9]+)", 1), "bigint").alias("k"),
        S.cast_or_null(F.when(F.col("event_type") == "click", "n/a")
                       .otherwise(F.col("event_id").cast("string")), "bigint").alias("n"),
        S.cast_or_null(F.when(F.col("event_type") == "view", "1,5")
                       .otherwise(F.col("value").cast("string")), "double").alias("v"))


@query("f06_parse_date", """
SELECT o_orderkey, strftime(try_strptime(CASE WHEN o_orderstatus = 'P' THEN strftime(o_orderdate, '%Y.%m.%d')
 ELSE strftime(o_orderdate, '%-d/%-m/%Y') END, '%d/%m/%Y'), '%Y-%m-%d') AS d FROM orders""")
def _(t):
    raw = (F.when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "yyyy.MM.dd"))
           .otherwise(F.date_format("o_orderdate", "d/M/yyyy")))
    return t.orders.select("o_orderkey", S.parse_date(raw, "%d/%m/%Y").cast("string").alias("d"))


_THREE_WAYS = """CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y')
 WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%d-%b-%Y')
 ELSE 'week ' || strftime(o_orderdate, '%d') END"""


def _three_ways():
    return (F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "dd/MM/yyyy"))
            .when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
            .when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "dd-MMM-yyyy"))
            .otherwise(F.concat(F.lit("week "), F.date_format("o_orderdate", "dd"))))


@query("f07_parse_date_any", f"""
SELECT o_orderkey, strftime(coalesce(try_strptime({_THREE_WAYS}, '%d/%m/%Y'),
 try_strptime({_THREE_WAYS}, '%Y-%m-%d'), try_strptime({_THREE_WAYS}, '%d-%b-%Y')), '%Y-%m-%d') AS d FROM orders""")
def _(t):
    S.register_mapping_functions(t.spark)
    return (t.orders.withColumn("raw", _three_ways())
            .select("o_orderkey", F.expr("parse_date_any(raw)").cast("string").alias("d")))


@query("f08_parse_datetime", """
SELECT event_id, strftime(CASE WHEN event_type = 'error' THEN NULL ELSE date_trunc('second', ts) END,
 '%Y-%m-%d %H:%M:%S') AS at FROM events""")
def _(t):
    raw = (F.when(F.col("event_type") == "error", F.lit("soon"))
           .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    return t.events.select("event_id", F.date_format(S.parse_datetime(raw), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("f09_date_of_datetime", """
SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS d FROM events""")
def _(t):
    return t.events.select("event_id", S.date_part(F.col("ts")).cast("string").alias("d"))


@query("f10_titlecase", r"""
SELECT doc_id, sha256(coalesce(list_aggregate(list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+'),
 lambda x: CASE x[1] WHEN 'ß' THEN 'SS' ELSE upper(x[1]) END || lower(x[2:])), 'string_agg', ''), '')) AS title_sha FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.sha2(S.titlecase(F.col("text")), 256).alias("title_sha"))


@query("f11_strip_chars", """
SELECT p_partkey, p_name AS name, CAST(length(p_name) AS BIGINT) AS n FROM part""")
def _(t):
    padded = F.concat(F.lit(" \t "), F.col("p_name"), F.lit(" \n "))
    name = S.strip_chars(padded)
    return t.part.select("p_partkey", name.alias("name"), F.length(name).cast("bigint").alias("n"))


@query("f12_to_uppercase", "SELECT doc_id, sha256(upper(replace(text, 'ß', 'SS'))) AS upper_sha FROM documents")
def _(t):
    return t.documents.select("doc_id", F.sha2(F.upper("text"), 256).alias("upper_sha"))


@query("f13_replace_values", """
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Construction' WHEN 'MACHINERY' THEN 'Plant'
 ELSE c_mktsegment END AS segment FROM customer""")
def _(t):
    return t.customer.select("c_custkey", S.replace_values(
        F.col("c_mktsegment"), {"BUILDING": "Construction", "MACHINERY": "Plant"}).alias("segment"))


@query("f14_contains_regex", """
SELECT p_partkey, regexp_matches(p_name, '(?i)(RING|bolt)$') AS hit,
 CASE WHEN regexp_matches(p_type, '(?i)^econ') THEN 'Economy' ELSE 'Other' END AS class FROM part""")
def _(t):
    return t.part.select("p_partkey", F.col("p_name").rlike("(?i)(RING|bolt)$").alias("hit"),
                         F.when(F.col("p_type").rlike("(?i)^econ"), "Economy").otherwise("Other").alias("class"))


@query("f15_starts_with", """
SELECT o_orderkey, starts_with(CAST(o_orderkey AS VARCHAR), '99') AS test_order FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", F.col("o_orderkey").cast("string").startswith("99").alias("test_order"))


@query("f16_extract_first", """
SELECT page_id, CASE WHEN regexp_matches(url, 'page=([0-9]+)') THEN regexp_extract(url, 'page=([0-9]+)', 1) END AS page,
 CASE WHEN regexp_matches(url, '^https?://([^/]+)') THEN regexp_extract(url, '^https?://([^/]+)', 1) END AS host
FROM pages""")
def _(t):
    S.register_mapping_functions(t.spark)
    return t.pages.select("page_id", F.expr("extract_first(url, 'page=([0-9]+)')").alias("page"),
                          S.extract_first(F.col("url"), "^https?://([^/]+)").alias("host"))


@query("f17_replace_regex", """
SELECT doc_id, sha256(regexp_replace(text, '[aeiou]n', '<>', 'g')) AS all_sha,
 sha256(regexp_replace(text, '[aeiou]n', '<>')) AS first_sha FROM documents""")
def _(t):
    return t.documents.select(
        "doc_id", F.sha2(S.replace_all(F.col("text"), "[aeiou]n", "<>"), 256).alias("all_sha"),
        F.sha2(S.replace_first(F.col("text"), "[aeiou]n", "<>"), 256).alias("first_sha"))


@query("f18_is_in", """
SELECT o_orderkey, o_orderpriority AS priority FROM orders
WHERE NOT upper(o_orderpriority) IN ('5-LOW', '2-HIGH')""")
def _(t):
    return (t.orders.where(~F.upper("o_orderpriority").isin("5-LOW", "2-HIGH"))
            .select("o_orderkey", F.col("o_orderpriority").alias("priority")))


@query("f19_arithmetic", """
SELECT l_orderkey, l_linenumber, round(l_quantity * l_extendedprice, 4) AS total,
 round(l_extendedprice / nullif(l_tax, 0), 4) AS per_tax,
 round(CASE WHEN l_returnflag = 'A' THEN l_quantity / 1000 ELSE l_quantity END, 6) AS tonnes FROM lineitem""")
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber",
        F.round(F.col("l_quantity") * F.col("l_extendedprice"), 4).alias("total"),
        F.round(F.try_divide("l_extendedprice", "l_tax"), 4).alias("per_tax"),
        F.round(F.when(F.col("l_returnflag") == "A", F.col("l_quantity") / 1000)
                .otherwise(F.col("l_quantity")), 6).alias("tonnes"))


@query("f20_round_money", """
SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(6,4))), 2)
 AS DOUBLE) AS net FROM lineitem""")
def _(t):
    net = F.col("l_extendedprice").cast("decimal(18,4)") * (1 - F.col("l_discount").cast("decimal(6,4)"))
    return t.lineitem.select("l_orderkey", "l_linenumber", S.money(net).cast("double").alias("net"))


@query("f21_comparisons", """
SELECT s_suppkey, s_acctbal > 0 AS positive, s_acctbal >= 1000 AND s_acctbal < 5000 AS mid,
 nullif(s_nationkey, 7) IS NOT NULL AS has_nation, nullif(s_nationkey, 7) <> 3 AS not_three FROM supplier""")
def _(t):
    nation = F.nullif(F.col("s_nationkey"), F.lit(7))
    return t.supplier.select(
        "s_suppkey", (F.col("s_acctbal") > 0).alias("positive"),
        ((F.col("s_acctbal") >= 1000) & (F.col("s_acctbal") < 5000)).alias("mid"),
        nation.isNotNull().alias("has_nation"), (nation != 3).alias("not_three"))


@query("f22_aggregate_functions", """
SELECT o_custkey, CAST(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,4)) END), 0) AS DOUBLE)
 AS finished, min(o_totalprice) AS low, max(o_totalprice) AS high,
 CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS mean, count(*) AS n,
 count(DISTINCT o_orderstatus) AS states, arg_min(o_orderpriority, o_orderkey) AS first_priority,
 arg_max(o_orderpriority, o_orderkey) AS last_priority FROM orders GROUP BY o_custkey""")
def _(t):
    price = F.col("o_totalprice").cast("decimal(18,4)")
    key = F.col("o_orderkey")
    return t.orders.groupBy("o_custkey").agg(
        S.sum_or_zero(F.when(F.col("o_orderstatus") == "F", price)).cast("double").alias("finished"),
        F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"),
        (F.sum(price).cast("double") / F.count("*")).alias("mean"), F.count("*").alias("n"),
        F.countDistinct("o_orderstatus").alias("states"),
        S.first_by(F.col("o_orderpriority"), key).alias("first_priority"),
        S.last_by(F.col("o_orderpriority"), key).alias("last_priority"))


@query("f23_snippet", """
SELECT doc_id, replace(substring(text, 1, 300), chr(10), ' ') AS snippet FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.translate(S.snippet(F.col("text"), 300), "\n", " ").alias("snippet"))

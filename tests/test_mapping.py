import datetime as dt

from pyspark.sql import functions as F

from mapweave.functions.scalar import register_mapping_functions, replace_first
from mapweave.operators import mapping as M
from mapweave.operators import rules as R
from mapweave.schemas import MappingColumn as MC
from mapweave.schemas import TargetColumn as TC
from mapweave.schemas import TargetTable


def col(table, target, source, column, expression=None, n=0, **more):
    return MC(table, target, source_columns=((source, column),), expression=expression, sort_order=n, **more)


SF = "/root/testdata/sf0.001"


def test_plain_maps_with_a_contract(spark):
    data = spark.createDataFrame([("17", "bolt", "0.25"), ("18", "washer", "0.5")], "sku string, label string, kilos string")
    spec = [col("items", "sku", "stock.csv", "sku"), col("items", "title", "stock.csv", "label", n=1),
            col("items", "weight", "stock.csv", "kilos", n=2)]
    contract = TargetTable("items", (TC("sku", "Int64", True, True), TC("title", "String", True), TC("weight", "Float64")))
    out = M.apply_spec(spec, {"stock": data}, [contract])["items"]  # file stem fallback
    assert [tuple(r) for r in out.orderBy("sku").collect()] == [(17, "bolt", 0.25), (18, "washer", 0.5)]
    results = R.run_rules(out, R.rules_of(spec, [contract])).collect()
    assert [(r["test_name"], r["passed"]) for r in results] == [
        ("items.sku.not_null", True), ("items.sku.unique", True), ("items.title.not_null", True)]


def test_orders_with_defects(spark):
    """Orders of the given tables; every 9th is a draft, every 11th has no parsable date, every 13th no total."""
    register_mapping_functions(spark)
    orders = spark.read.parquet(f"{SF}/orders.parquet").selectExpr(
        "o_orderkey AS k", "concat('C', o_custkey) AS buyer", "IF(o_orderkey % 9 = 0, ' draft', o_orderstatus) AS state",
        "IF(o_orderkey % 13 = 0, 'n/a', cast(o_totalprice AS string)) AS total",
        "CASE WHEN o_orderkey % 11 = 0 THEN 'soon' WHEN o_orderkey % 2 = 0 THEN date_format(o_orderdate, 'dd/MM/yyyy') "
        "ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS day")
    buyers = spark.read.parquet(f"{SF}/customer.parquet").selectExpr("concat('C', c_custkey) AS code", "c_mktsegment AS segment")
    contract = TargetTable("sales", (TC("id", "String", True, True), TC("segment", "String", True), TC("amount", "Float64", True), TC("day", "Date")))
    spec = [
        MC("sales", "_real", "filter", (("orders", "state"),), sort_order=-1, filter_expression="upper(strip_chars(state)) <> 'DRAFT'"),
        MC("sales", "segment", "lookup", (("orders", "buyer"),), lookup_table="buyers", lookup_key="code", lookup_value="segment", sort_order=1),
        col("sales", "amount", "orders", "total", "try_cast(total AS double)", 2, tests=("positive",)),
        col("sales", "day", "orders", "day", "parse_date_any(day)", 3),
        col("sales", "id", "orders", "k", "concat(segment, '-', k)", 4),
    ]
    out = M.apply_spec(spec, {"orders": orders, "buyers": buyers}, [contract])["sales"]
    keys = [r.k for r in orders.collect() if r.k % 9]
    assert out.count() == len(keys)
    bad_total = sum(k % 13 == 0 for k in keys)
    facts = out.selectExpr("count_if(amount IS NULL)", "count_if(day IS NULL)", "count_if(segment IS NULL)").head()
    assert tuple(facts) == (bad_total, sum(k % 11 == 0 for k in keys), 0)
    results = {r["test_name"].split(".", 1)[1]: r["passed"] for r in R.run_rules(out, R.rules_of(spec, [contract])).collect()}
    assert not results["amount.not_null"] and results["id.unique"] and results["amount.positive"] and results["segment.not_null"]
    assert R.violations(out, R.Rule("sales", "amount", "not_null", "error")).count() == bad_total


def test_suppliers_with_totals(spark):
    register_mapping_functions(spark)
    firms = spark.createDataFrame([(4, " okoro & sons ", "N"), (5, "delta works", "S"), (6, "q", None)], "fid bigint, title string, side string")
    loads = spark.createDataFrame([(71, 4, 3, 1.25), (72, 4, -2, 0.5), (73, 5, 7, None), (80_000, 5, 4, 2.0)],
                                  "load bigint, fid bigint, crates bigint, fee double")
    f = "firms"
    spec = [
        col(f, "firm", "f", "fid"), col(f, "name", "f", "title", "titlecase(strip_chars(title))", 1),
        col(f, "side", "f", "side", "CASE side WHEN 'N' THEN 'north' ELSE side END", 2),
        MC(f, "fees", "aggregation", (("f", "fid"),), aggregation_table="l", aggregation_key="fid",
           aggregation_expression="coalesce(sum(crates * fee), 0)", sort_order=3),
        MC(f, "n", "aggregation", (("f", "fid"),), aggregation_table="l", aggregation_key="fid",
           aggregation_expression="count(*)", sort_order=4),
        MC("loads", "_real", "filter", (("l", "load"),), filter_expression="load < 80000"),
        col("loads", "load", "l", "load", n=1), col("loads", "cost", "l", "crates", "round(crates * fee, 2)", 2),
    ]
    out = M.apply_spec(spec, {"f": firms, "l": loads})
    assert list(out) == ["firms", "loads"]
    assert [tuple(r) for r in out["firms"].orderBy("firm").collect()] == [
        (4, "Okoro & Sons", "north", 2.75, 2), (5, "Delta Works", "S", 8.0, 2), (6, "Q", None, None, None)]
    assert [r["load"] for r in out["loads"].orderBy("load").collect()] == [71, 72, 73]
    # Aggregates of one source and key share one scan and one join.
    plan = out["firms"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1


def test_hot_key_of_an_aggregation_join_is_spread(spark, tmp_path):
    base = spark.range(40_000).selectExpr("id", "IF(id % 10 = 0, id, 7) AS `a.k`")
    table = spark.range(40_000).selectExpr("id % 500 AS `a.k`", "id AS v")
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    old = {n: spark.conf.get(n) for n in names}
    for n, v in zip(names, ("-1", "32", "false")):
        spark.conf.set(n, v)
    try:
        out = M.aggregate_join(base, table, "a.k", "a.k", {"n": "count(*)"})
        out.write.parquet(str(tmp_path / "out"))
    finally:
        for n, v in old.items():
            spark.conf.set(n, v)
    back = spark.read.parquet(str(tmp_path / "out"))
    per_task = [r["count"] for r in back.groupBy(F.col("_metadata.file_path")).count().collect()]
    assert sum(per_task) == 40_000 and max(per_task) < 12_000
    assert back.where("`a.k` = 7 AND n = 80").count() == 36_000


def test_lookup_edges(spark):
    base = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "id int, k string")
    lut = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), (None, "null key")], "k string, v string")
    spec = [col("t", "id", "b", "id"), MC("t", "k", "lookup", (("b", "k"),), lookup_table="l", lookup_key="k", lookup_value="v", sort_order=1)]
    out = M.apply_spec(spec, {"b": base, "l": lut})["t"]
    # Repeats fan out, nulls never match, and the target takes the looked-up value.
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "x"), (1, "y"), (2, None), (3, None)]
    assert [tuple(r) for r in M.duplicate_lookup_keys(lut, "k", "v").collect()] == [("a", 2)]


def test_dtype_edges(spark):
    df = spark.createDataFrame([("1.5", "5/3/2024", 300, "true"), (" 7 ", "2024-13-01", -1, "maybe"), (None, "", 5, None)],
                               "i string, d string, u bigint, b string").withColumn("n", F.lit(None))
    table = TargetTable("t", (TC("i", "Int64"), TC("d", "Date"), TC("u", "UInt8"), TC("b", "Boolean"), TC("n", "Float64"), TC("x", "Nope")))
    out = M.enforce_dtypes(df, table)
    assert [tuple(r) for r in out.collect()] == [(None, dt.date(2024, 3, 5), None, True, None), (7, None, None, None, None), (None, None, 5, None, None)]
    assert dict(out.dtypes)["n"] == "double"


def test_rules_on_empty_frame(spark):
    empty = spark.createDataFrame([], "a int")
    rules = [R.Rule("t", "a", x, "error") for x in ("not_null", "unique", "positive", "a < 3")]
    assert all(r["passed"] for r in R.run_rules(empty, rules).collect())
    assert R.run_rules(empty, []).count() == 0


def test_replace_first(spark):
    df = spark.createDataFrame([("a-b-c\n-d",), ("none",)], "s string")
    assert [r[0] for r in df.select(replace_first(F.col("s"), "-", "+")).collect()] == ["a+b-c\n-d", "none"]


def test_all_null_group_sums_to_zero(spark):
    from mapweave.functions.scalar import sum_or_zero
    df = spark.createDataFrame([(1, None), (1, None), (2, 3.0)], "k int, v double")
    assert {r["k"]: r["s"] for r in df.groupBy("k").agg(sum_or_zero(F.col("v")).alias("s")).collect()} == {1: 0.0, 2: 3.0}

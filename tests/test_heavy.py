"""Hot keys by sketch, and joins that treat them apart."""

from pyspark.sql import functions as F

from mapweave.operators import heavy
from mapweave.operators.mapping import aggregate_join
from mapweave.operators.rules import Rule, violations


def keyed(spark):
    k = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id") + 1000)
    return spark.range(30_000).select("id", k.alias("k"))


def test_sketches_merge_and_name_the_hot_key(spark):
    rows = keyed(spark)
    parts = [heavy.sketch(rows.where(F.col("id") % 2 == p), F.col("k"), 64) for p in (0, 1)]
    state = heavy.merged(parts[0].union(parts[1]), 64)
    assert state.select("n").first().n == 20_000
    [hot] = heavy.hot_keys(state, hot_rows=2000, most=50).collect()
    assert hot.key_hash == rows.select(F.xxhash64(F.lit(7).cast("bigint"))).first()[0] and 10_000 <= hot.rows <= 10_000 + 20_000 // 48
    assert heavy.hot_keys(heavy.sketch(rows.where("false"), F.col("k"))).collect() == []


def test_join_of_hot_cold_and_null_keys(spark):
    rows = keyed(spark)
    table = spark.createDataFrame([(7, 1.0), (7, 2.0), (1001, 5.0), (None, 9.0), (4, 4.0)], "k bigint, v double")
    joined = aggregate_join(rows, table, "k", "k", {"total": "sum(v)", "n": "count(*)"}, hot_rows=1000)
    assert joined.count() == 30_000
    found = {(r.k, r.total, r.n): r["count"] for r in joined.groupBy("k", "total", "n").count().where("total IS NOT NULL").collect()}
    assert found == {(7, 3.0, 2): 10_000, (1001, 5.0, 1): 1}
    assert joined.where("k IS NULL").count() == 10_000


def test_hot_rows_are_not_shuffled(spark):
    rows = keyed(spark)
    table = rows.select("k", "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = aggregate_join(rows, table, "k", "k", {"n": "count(*)"}, hot_rows=1000)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in plan and "BroadcastHashJoin" in plan and plan.count("SortMergeJoin") == 1


def test_repeated_values_are_found_without_gathering_nulls_or_a_hot_value(spark):
    """Of 30,000 rows 10,000 have no value and 10,000 have the value 7; neither is joined by its value with the rest."""
    rows = keyed(spark).unionAll(spark.createDataFrame([(1, 1001), (4, 2001)], "id long, k long"))
    rule = Rule("t", "k", "unique", "error")
    got = violations(rows, rule, hot_rows=2000)
    want = sorted(r.id for r in rows.collect() if r.k in (None, 7, 1001))
    assert sorted(r.id for r in got.collect()) == want and got.columns == ["id", "k"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "<=>" not in plan
    one = spark.createDataFrame([(1, None), (2, 5), (3, 6)], "id int, k int")
    assert violations(one, rule).count() == 0
    assert violations(one.unionAll(one.where("k IS NULL")), rule).count() == 2

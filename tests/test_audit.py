import datetime as dt

import pytest
from pyspark.sql import functions as F

from mapweave.operators import audit as A
from mapweave.operators import profile as P


def test_pages(spark, tmp_path):
    kept = A.Pages.write(spark.range(991).select((F.col("id") * 7 % 991 * 3).alias("k")).repartition(5), "k", str(tmp_path / "p"))
    for number, size in [(1, 10), (7, 10), (50, 10), (99, 10), (10**6, 10), (3, 7), (61, 16), (0, 5), (1, 5000)]:
        got, facts = kept.page(number, size)
        pages = -(-991 // size)
        n = min(max(number, 1), pages)
        want = [i * 3 for i in range(991)][(n - 1) * size:n * size]
        assert [r["k"] for r in got.collect()] == want
        assert facts == {"page": n, "total_pages": pages, "total_rows": 991, "start_row": (n - 1) * size + 1, "end_row": (n - 1) * size + len(want)}


def test_pages_read_few_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        kept = A.Pages.write(spark.range(8000).selectExpr("cast(id % 4000 AS string) AS k", "id"), "k", str(tmp_path / "p"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert kept.directory.count() == 16
    got, _ = kept.page(200, 20)
    assert len(got.select(F.input_file_name().alias("f")).distinct().collect()) <= 2
    want = sorted((str(i % 4000), i) for i in range(8000))[3980:4000]
    assert [tuple(r) for r in got.collect()] == want  # text order, equal keys in order of the input
    assert [tuple(r) for r in A.Pages(spark, str(tmp_path / "p")).page(200, 20)[0].collect()] == want


def test_pages_with_null_keys_and_one_hot_key(spark, tmp_path):
    keys = [None] * 301 + ["same"] * 400 + [f"t{i:04}" for i in range(299)]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int").repartition(4)
    kept = A.Pages.write(rows, "k", str(tmp_path / "p"))
    seen = [r for n in range(1, 21) for r in kept.page(n, 50)[0].collect()]
    assert sorted(r.i for r in seen) == list(range(1000))
    assert [r.k for r in seen] == keys


def test_page_of_numbers_with_a_null_and_empty_frame(spark):
    rows = spark.range(2000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"))
    assert [r["k"] for r in A.page(rows, "k", 50, 10)[0].collect()] == list(range(490, 500))
    got, facts = A.page(rows.where("false"), "k", 4, 10)
    assert got.count() == 0 and got.columns == ["k"] and facts["page"] == 1 and facts["total_pages"] == 1


def test_audit_limits(spark):
    log = spark.createDataFrame([(i, "e", dt.datetime(2024, 1, 1 + i % 5)) for i in range(20)], "id int, event_type string, recorded_at timestamp_ntz")
    assert [r["id"] for r in A.query_audit(log, 3, event_type="e").collect()] == [4, 9, 14]
    for limit in (0, 501):
        with pytest.raises(ValueError):
            A.query_audit(log, limit)


def test_patch_can_set_null(spark):
    stored = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "k int, x string, y string")
    changes = spark.createDataFrame([(1, ["x"], None, "ignored")], "k int, given array<string>, x string, y string")
    assert sorted(map(tuple, A.patch(stored, changes, "k", ["x", "y"]).collect()), key=str) == [(1, None, "b"), (2, "c", "d")]


def test_upsert_tie_goes_to_fresh(spark):
    a = spark.createDataFrame([(1, "old", 5), (2, "keep", 9)], "k int, v string, at int")
    b = spark.createDataFrame([(1, "new", 5), (2, "stale", 3), (3, "add", 1)], "k int, v string, at int")
    assert {r["k"]: r["v"] for r in A.upsert(a, b, "k", "at").collect()} == {1: "new", 2: "keep", 3: "add"}


def test_frame_profile_example(spark):
    df = spark.createDataFrame([(1, "Alice", 10.5), (2, "Bob", 20.0), (3, None, 30.0)], "id int, name string, amount double")
    got = {r["column"]: r for r in P.frame_profile(df, [F.col("id")]).collect()}
    assert (got["id"]["non_null_count"], got["name"]["null_count"], got["amount"]["unique_count"]) == (3, 1, 3)
    assert got["name"]["examples"] == ["Alice", "Bob"]


def test_distinct_counts_differ_by_definition(spark):
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "a")], "k int, v string")
    order = [F.col("k")]
    assert P.catalog_profile(df, order, ["v"]).head()["cardinality"] == 1
    assert P.frame_profile(df, order).where("column = 'v'").head()["unique_count"] == 2
    assert P.quality_profile(df).where("column = 'v'").head()["unique_count"] == 3


def test_infer_types_of_text(spark):
    df = spark.createDataFrame([("1", "1.5", "TRUE", "", "1d", "2024-01-01"), ("-2", "3", "false", None, "2", "x")], "a string, b string, c string, d string, e string, f string")
    assert [(r["inferred_type"], r["load_type"]) for r in P.infer_types(df).collect()] == [
        ("string", "bigint"), ("string", "double"), ("string", "boolean"), ("null", "string"), ("string", "string"), ("string", "string")]


def test_column_summary_of_mixed_cells(spark):
    rows = [(1, "h", i, str(i), "int") for i in range(20)] + [(1, "h", 20, "x", "str"), (1, "h", 21, None, "str"), (2, "g", 0, "", "str"), (3, "e", 0, None, "str")]
    cells = spark.createDataFrame(rows, "col_idx int, header string, row_idx bigint, value string, type string")
    got = {r["col_idx"]: r for r in P.column_summary(cells).collect()}
    assert got[1]["first_values"] == [str(i) for i in range(8)] and got[1]["last_values"] == [str(i) for i in range(13, 20)] + ["x"]
    assert got[1]["type_inconsistencies"] == "int in 20 of 21 cells; others: str (1)" and got[1]["distinct_values"] is None
    assert got[2]["distinct_values"] == [""] and got[2]["last_values"] is None
    assert got[3]["non_empty_count"] == 0 and got[3]["dominant_type"] is None


def test_specs_of_one_client_are_dealt(spark):
    specs = spark.range(1000).selectExpr("id AS spec_id", "if(id < 990, 1, id) AS client_id").unionAll(
        spark.createDataFrame([(5, None), (6, 1), (6, 1)], "spec_id long, client_id long"))
    rules = spark.range(60).selectExpr("id AS rule_id", "if(id < 50, 1, if(id < 58, 995, null)) AS client_id",
                                       "if(id % 2 = 0, 'approved', 'draft') AS status", "concat('r', id) AS rule_text")
    got = A.active_rules(rules, specs)
    assert got.columns == ["client_id", "spec_id", "rule_id", "rule_text"]
    want = specs.join(rules.where("status = 'approved'").drop("status"), "client_id").select(got.columns)
    assert got.count() == want.count() == 992 * 25 + 4 and got.exceptAll(want).isEmpty()
    # The join is on the part, too: one client is no longer one task's.
    assert "_part" in got._jdf.queryExecution().optimizedPlan().toString()


def test_rules_come_rule_by_rule_for_a_block_of_specs(spark):
    specs = spark.range(600).selectExpr("id AS spec_id", "1L AS client_id").union(
        spark.createDataFrame([(7, 1), (None, 1), (None, 1), (9, 2)], "spec_id long, client_id long"))
    rules = spark.range(301).selectExpr("if(id = 300, null, id) AS rule_id", "1L AS client_id", "'approved' AS status", "concat('r', id % 9) AS rule_text")
    rules = rules.union(rules.where("rule_id < 2"))
    rows = [tuple(r) for r in A.active_rules(rules, specs, parts=1).collect()]
    assert len(rows) == 603 * 303 and len(set(rows)) == 601 * 301
    assert rows.count((1, None, 1, "r1")) == 4 and rows.count((1, 7, None, "r3")) == 2
    # Three blocks of specs: a rule stands beside all specs of a block before the next rule comes.
    changes = sum(a[2:] != b[2:] for a, b in zip(rows, rows[1:]))
    assert changes < 3 * 303

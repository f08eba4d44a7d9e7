import json

import pytest
from pyspark.sql import functions as F

from mapweave.operators import catalog as C
from mapweave.operators.nesting import join_text, nest


def catalog(spark, *tables):
    docs = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(tables)], "pos0 bigint, catalog_json string")
    cols = C.catalog_columns(C.catalog_tables(docs))
    return cols.withColumn("scope", F.lit("s")).withColumn("pos", F.col("pos0") * 10000 + F.col("table_pos") * 100 + F.col("column_pos"))


def table(tid, cols, **more):
    return {"source_table_id": tid, "columns": [{"source_column_id": i, "normalized_name": n} for i, n in cols], **more}


@pytest.fixture(scope="module")
def columns(spark):
    return catalog(
        spark, {"tables": [table("table-1", [("column-1", "revenue"), ("c1", "CustomerID")], original_filename="data.csv", display_name="Orders", raw_file_id="raw-1")]},
        {"tables": [table("t2", [("c2", "revenue")], original_filename="other.csv", display_name="orders"),
                    table("lookup-tbl", [("c3", "code"), ("c4", "label")], original_filename="lookup.csv", display_name="Lookups")]}).cache()


def resolve(spark, columns, *refs):
    df = spark.createDataFrame([("s", i, t, c) for i, (t, c) in enumerate(refs)], "scope string, i int, source_table string, source_column string")
    return C.resolve_columns(df, columns).orderBy("i").collect()


def test_resolution_tiers(spark, columns):
    rows = resolve(spark, columns, ("data.csv::Orders", "revenue"), ("data.csv::Orders", "customerid"), ("ORDERS", "Revenue"), ("data.csv::Orders", "MissingCol"))
    assert [(r["tier"], r["source_column_id"]) for r in rows] == [(1, "column-1"), (2, "c1"), (3, "column-1"), (None, None)]
    assert rows[0]["raw_file_id"] == "raw-1" and "MissingCol" in rows[3]["error"] and rows[0]["error"] is None


def test_table_keys(spark, columns):
    tables = columns.groupBy("scope", "source_table_id", "original_filename", "display_name", "sheet_name").agg(F.min("pos").alias("pos"))
    refs = spark.createDataFrame([("s", "lookup.csv::Lookups"), ("s", "lookups"), ("s", "nope")], "scope string, table_key string")
    got = {r["table_key"]: (r["source_table_id"], r["error"]) for r in C.resolve_tables(refs, tables).collect()}
    assert got["lookup.csv::Lookups"] == got["lookups"] == ("lookup-tbl", None) and "nope" in got["nope"][1]


def test_checks(spark, columns):
    refs = spark.createDataFrame([
        (1, "s", "table-1", "column-1", "raw-1"), (2, "s", "table-1", "c2", "raw-1"), (3, "s", "gone", "c2", None),
        (4, "s", None, "c2", None), (5, "s", "table-1", "column-1", None), (6, "s", "t2", None, None)],
        "mapping_id int, scope string, source_table_id string, source_column_id string, raw_file_id string")
    errors = {r["mapping_id"]: r["error"] for r in C.check_sources(refs, columns).collect()}
    assert set(errors) == {2, 3, 4, 5, 6} and "does not belong" in errors[2] and "not in the catalog" in errors[3]
    maps = spark.createDataFrame([(1, "s", "lookup-tbl", "code", "label"), (2, "s", "lookup-tbl", "bad", "label"), (3, "s", "gone", "code", "x")],
                                 "mapping_id int, scope string, t string, k string, v string")
    found = {(r["mapping_id"], r["error"]) for r in C.check_named_columns(maps, columns, "t", {"k": "lookup_key", "v": "lookup_value"}).collect()}
    assert found == {(2, "lookup_key 'bad' not in table lookup-tbl"), (3, "table gone is not in the catalog")}


def test_coverage(spark):
    contract = spark.createDataFrame([("c", "customer_id", True), ("c", "total_spend", False)], "target_table string, target_column string, required boolean")
    mapped = spark.createDataFrame([("c", "customer_id"), ("c", "customer_id")], "target_table string, target_column string")
    assert {r["target_column"]: r["coverage"] for r in C.coverage(mapped, contract).collect()} == {
        "customer_id": "covered_required", "total_spend": "missing_optional"}


def test_catalog_shapes(spark):
    rows = catalog(spark, {"sheets": [table("a", [("1", "x")])]}, table("b", [("2", "y")], display_name="B"), {"tables": []}).collect()
    assert {(r["source_table_id"], r["column_name"]) for r in rows} == {("a", "x"), ("b", "y")}


def test_nesting_is_sliced_and_whole(spark):
    children = spark.range(2000).select((F.col("id") % 10 > 0).cast("int").alias("k"), F.col("id"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    got = nest(children, ["k"], "id", ["name"], "items", slice_rows=500)
    sizes = {}
    for r in got.collect():
        names = [x["name"] for x in r["items"]]
        assert names == sorted(names, key=lambda n: int(n[1:])) and len(names) <= 500
        sizes.setdefault(r["k"], []).extend(names)
    assert {k: len(set(v)) for k, v in sizes.items()} == {0: 200, 1: 1800}
    text = join_text(children.where("id < 5"), ["k"], "id", F.col("name"), ",", "t").where("k = 1").head()
    assert text["t"] == "n1,n2,n3,n4" and text["slice_no"] == 0

import __spark_entry__ as entry
import corpus_pipeline
from mapweave.llm import queries

SF = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    names = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op"))
    assert names == list(range(1, 14)) and "pipeline" in queries.QUERIES
    assert set(queries.QUERIES) <= set(entry.queries())


def test_pipeline_keeps_columns_and_rows_of_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    names, before = docs.columns, docs.count()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(step(spark, docs, SF), "pipeline-test")
        assert docs.columns == names and 0 < docs.count() <= before
        before = docs.count()
        if name == "quality classifier":
            kept = {r.doc_id for r in docs.select("doc_id").collect()}
            good = [i for i, r in labels.items() if r.quality == 1]
            assert sum(i in kept for i in good) >= 0.98 * len(good)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert set(names) < set(last.columns)
    # Each document stands in the mixed corpus as often as its rate says, rounded up or down.
    for row in last.groupBy("doc_id", "copies", "rate").count().collect():
        assert row["count"] == row.copies and abs(row.copies - row.rate) < 1
    assert docs.filter("text like '%@mail%'").count() == 0

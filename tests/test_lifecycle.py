import pytest

from mapweave.operators.lifecycle import execute, ingest_folder
from mapweave.schemas import MappingColumn as MC
from mapweave.schemas import TargetColumn as TC
from mapweave.schemas import TargetTable
from mapweave.sources import tabular as T


def test_folder_to_catalog_to_targets(spark, tmp_path):
    folder = tmp_path / "client"
    folder.mkdir()
    (folder / "data.csv").write_text("sku,label,kilos\n31,hinge,4.75\n32,latch,\n")
    (folder / "bad.csv").write_text('sku,label\n31,"hinge')
    (folder / "rules.eml").write_text("Subject: scales\n\nkilos stay above 0\n" + "x" * 1500)
    (folder / "target_schema.json").write_text("{}")
    got = ingest_folder(spark, str(folder), "acme", "b1")
    assert {r["original_filename"]: r["status"] for r in got.registry.collect()} == {"data.csv": "parsed", "bad.csv": "failed", "rules.eml": "parsed"}
    summary = got.summary.head()
    assert (summary["files"], summary["parsed_count"], summary["failed_count"]) == (3, 2, 1)
    assert [len(r["content"]) for r in got.chunks.orderBy("chunk_index").collect()] == [1000, 719]
    table = got.catalog.tables.head()
    columns = got.catalog.columns.where(f"source_table_id = '{table['source_table_id']}'").orderBy("ordinal").collect()
    layout = T.CsvLayout(tuple(c["normalized_name"] for c in columns), table["delimiter"], encoding=table["encoding"],
                         header_row=table["header_row"], types=tuple(c["load_type"] for c in columns))
    assert layout.types == ("bigint", "string", "double")
    tid = table["source_table_id"]
    sources = T.load_sources(spark, {tid: layout}, {tid: str(folder / "data.csv")})
    spec = [MC("records", "record_id", source_columns=((tid, "sku"),), column_id="m1"),
            MC("records", "score", source_columns=((tid, "kilos"),), sort_order=1, tests=("positive", "nonsense >"), column_id="m2")]
    contract = [TargetTable("records", (TC("record_id", "Int64", True, True), TC("score", "Float64", True)))]
    with pytest.raises(ValueError):
        execute(spark, "s1", "draft", spec, sources, contract, str(tmp_path / "out"))
    for _ in range(2):
        run = execute(spark, "s1", "approved", spec, sources, contract, str(tmp_path / "out"))
    assert sorted(map(tuple, run.targets["records"].collect()), key=str) == [(31, 4.75), (32, None)]
    assert {r["test_name"].split(".")[-1]: r["passed"] for r in run.results.where("severity = 'warning'").collect()} == {"positive": True, "nonsense >": False}
    assert run.results.where("test_name = 'records.score.not_null'").head()["passed"] is False
    staging = {r["column"]: r for r in run.staging.collect()}
    assert (staging["score"]["mapping_column_id"], staging["score"]["null_count"], staging["score"]["unique_count"]) == ("m2", 1, 2)
    assert spark.read.parquet(str(tmp_path / "out" / "runs")).count() == 2

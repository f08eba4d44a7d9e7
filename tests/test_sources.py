import email
import os
import pathlib

import pytest
from pyspark.sql import functions as F

from mapweave.functions.encoding import decode_text
from mapweave.operators import dialect as L
from mapweave.operators.discovery import discover_delimited
from mapweave.operators.loading import load_catalog
from mapweave.session import shared_dir
from mapweave.sources import email as E
from mapweave.sources import files as S
from mapweave.sources import tables as D
from mapweave.sources import tabular as T
from mapweave.streaming.ingest import register_folder


def test_cp1252_csv_with_preamble(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes("Lagerliste Mai\r\nnr;ort;text\r\n1;Görlitz;\"a; b\"\r\n2;Plön;\r\n3;€;x;too;long\r\n".encode("cp1252"))
    layout = T.CsvLayout(("nr", "ort", "text"), ";", encoding="cp1252", header_row=2, types=("bigint", "string", "string"))
    rows = T.read_delimited(spark, str(tmp_path / "c.csv"), layout).orderBy("nr").collect()
    assert [tuple(r)[:2] for r in rows] == [(1, "Görlitz"), (2, "Plön"), (3, "€")]
    assert rows[0]["text"] == "a; b" and rows[1]["text"] is None


def test_preamble_is_dropped_per_file_and_split(spark, tmp_path):
    for n in range(3):
        body = "".join(f"{n * 1000 + i},v\n" for i in range(400))
        (tmp_path / f"f{n}.csv").write_text("title\nsecond\nid,v\n" + body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        df = T.read_delimited(spark, str(tmp_path), T.CsvLayout(("id", "v"), header_row=3, types=("bigint", "string")))
        assert df.rdd.getNumPartitions() > 3
        assert sorted(r["id"] for r in df.collect()) == [n * 1000 + i for n in range(3) for i in range(400)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_encodings(spark):
    samples = {"utf-8-sig": b"\xef\xbb\xbfid", "utf-16": "id,é😀".encode("utf-16"), "utf-8": "é".encode(), "cp1252": b"caf\xe9 \x80", None: b"\x81\xff"}
    df = spark.createDataFrame([(str(k), bytearray(v)) for k, v in samples.items()], "k string, c binary")
    df = df.withColumn("e", L.encoding(F.col("c")))
    got = {r["k"]: (r["e"], r["t"]) for r in df.select("k", "e", L.decode(F.col("c"), F.col("e")).alias("t")).collect()}
    assert got == {"utf-8-sig": ("utf-8-sig", "id"), "utf-16": ("utf-16", "id,é😀"), "utf-8": ("utf-8", "é"), "cp1252": ("cp1252", "café €"), "None": (None, None)}
    be = spark.createDataFrame([(bytearray(b"\xfe\xff" + "hé".encode("utf-16-be")),), (bytearray(b"\xff\xfe\x00\xd8a\x00"),)], "c binary")
    assert [r[0] for r in be.select(L.encoding(F.col("c"))).collect()] == ["utf-16", "cp1252"]


def test_file_types_and_scan(spark, tmp_path):
    for name, body in (("a.CSV", b"x"), ("b.msg", b"x"), ("noext", b"PK\x03"), ("p.bin", b"%PDF-1"), ("u.bin", b"zz"), ("t.json", b"{}")):
        (tmp_path / name).write_bytes(body)
    scan = S.scan_folder(spark, str(tmp_path))
    kinds = {r["name"]: r["k"] for r in scan.select("name", S.file_type(F.col("name"), F.col("content")).alias("k")).collect()}
    assert kinds == {"a.CSV": "csv", "b.msg": "eml", "noext": "xlsx", "p.bin": "pdf", "u.bin": "unknown"}
    rows = S.registry_rows(scan, F.lit("acme"), F.lit("b1")).where("original_filename = 'a.CSV'").head()
    assert rows["storage_key"] == f"acme/b1/{rows['sha256'][:16]}_a.CSV" and rows["mime_type"] == "text/csv"


def test_streaming_registry_adds_each_file_once(spark, tmp_path):
    folder, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    folder.mkdir()
    (folder / "a.csv").write_text("1")
    register_folder(spark, str(folder), out, ck, "acme", "b").awaitTermination(60)
    (folder / "b.txt").write_text("2")
    (folder / "c.json").write_text("{}")
    register_folder(spark, str(folder), out, ck, "acme", "b").awaitTermination(60)
    assert sorted(r[0] for r in spark.read.parquet(out).select("original_filename").collect()) == ["a.csv", "b.txt"]


def test_contract_preference(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    assert os.path.basename(T.find_contract(spark, str(tmp_path))) == "a.json"
    (tmp_path / "schema.json").write_text('{"tables": [{"name": "t", "columns": [{"name": "x", "dtype": "Int64", "required": true}, {"name": "y"}]}]}')
    path = T.find_contract(spark, str(tmp_path))
    assert os.path.basename(path) == "schema.json"
    table, = T.target_tables(T.read_contracts(spark, path))
    assert [(c.name, c.dtype, c.required) for c in table.columns] == [("x", "Int64", True), ("y", None, False)]


def test_messages_agree_with_the_email_module(spark):
    raws = ["From: a@x\r\nSubject: one\r\n two\r\n\r\nbody\r\nline\r\n", "A: 1\nA: 2\n\nx\n\ny", "Only: header", "\nno headers",
            "Content-Transfer-Encoding: quoted-printable\n\ncaf=C3=A9 =\nsoft =3D done", "Content-Transfer-Encoding: base64\n\naMOp\nbGxv\n"]
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    for r in E.parse_messages(df).collect():
        msg = email.message_from_bytes(r["raw"].encode())
        assert r["body_text"] == msg.get_payload(decode=True).decode(), r["raw"]
        got = {h["name"]: h["value"] for h in r["headers"]}
        want = {k: " ".join(v.split()) for k, v in msg.items()}
        assert got == want, r["raw"]


def test_decode_drops_bad_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb\xc3"),)], "c binary")
    assert df.select(decode_text(F.col("c"))).head()[0] == b"a\xffb\xc3".decode("utf-8", errors="ignore")


def test_single_target_is_also_the_result(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"')], "a int, b string")
    paths = T.write_targets({"t": df}, str(tmp_path))
    assert paths["results"] == paths["t"]
    assert set(T.write_targets({"t": df, "u": df}, str(tmp_path / "two"))) == {"t", "u"}
    assert T.load_csv_folder(spark, paths["t"]) and pathlib.Path(paths["t"]).is_dir()


def test_replacing_one_partition_keeps_the_others(spark):
    path = shared_dir(spark, "t")
    D.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, "k")
    D.replace_partitions(spark.createDataFrame([(2, "c")], "k int, v string"), path, "k")
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("k", "v").collect()) == [(1, "a"), (2, "c")]
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_catalogued_files_load_as_discovered(spark, tmp_path):
    bodies = {
        "title": "Stock\n\nsku,label\n1,a\n2,b\n", "blank": "\nsku,label\n1,a\n2,b\n", "again": "sku,label\n1,a\nsku,label\n2,b\n",
        "wide": "sku,label\n1,a,x\n2,b\n", "lines": 'sku,label\n1,"a\nc"\n2,b\n'}
    for name, body in bodies.items():
        (tmp_path / f"{name}.csv").write_text(body)
    (tmp_path / "utf16.csv").write_bytes("sku,label\n1,a\n2,b\n".encode("utf-16"))
    files = S.scan_folder(spark, str(tmp_path)).selectExpr("name AS file_id", "content")
    catalog = discover_delimited(files)
    paths = {f"{n}.csv": str(tmp_path / f"{n}.csv") for n in (*bodies, "utf16")}
    frames = load_catalog(spark, catalog, paths)
    names = {r.source_table_id: r.file_id for r in catalog.tables.collect()}
    got = {names[k]: sorted(map(tuple, df.collect())) for k, df in frames.items()}
    assert got == {f"{n}.csv": [(1, "a\nc" if n == "lines" else "a"), (2, "b")] for n in (*bodies, "utf16")}
    (tmp_path / "blank.csv").write_text("sku,label\n9,z\n")
    with pytest.raises(ValueError, match="blank.csv"):
        load_catalog(spark, catalog, paths)

"""Files read in blocks of a few bytes: the same catalog and rows as from whole files."""

import csv
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from mapweave.operators.dialect import csv_grid
from mapweave.operators.discovery import discover_delimited, discover_paths
from mapweave.operators.loading import load_catalog
from mapweave.operators.transducer import block_grid
from mapweave.sources import blocks as B
from mapweave.sources import tabular as T
from mapweave.sources.tables import Folders, stage


@pytest.fixture
def small_blocks(spark, monkeypatch):
    """Blocks of 120 bytes and chunks of two lines."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "120")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    monkeypatch.setattr(B, "CHUNK_BITS", 1)
    yield
    for name in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{name}")


def quoted(text):
    return '"' + text.replace('"', '""') + '"'


def sample_files():
    rng = random.Random(8)

    def cell():
        text = "".join(rng.choice(["a", "é", "b c", "", ",", ";", '"', "\n", "\t", "|", "\r\n"]) for _ in range(rng.randrange(4)))
        return quoted(text) if rng.random() < 0.3 or any(c in text for c in ',;"\n\t|\r') else text

    files = {}
    kinds = [("utf-8", ","), ("utf-8-sig", ";"), ("cp1252", "\t"), ("utf-16", "|"), ("utf-16-be", ";"), ("utf-8", "|")]
    for i, (encoding, sep) in enumerate(kinds):
        rows = [sep.join(["id", "näme", "note"])] + [sep.join([str(k), cell(), cell()]) for k in range(6)]
        if i % 2:
            rows[:0] = ["Title", ""]
        if i == 5:
            rows.append(rows[2])
        text = ("\r\n" if i % 3 == 0 else "\n").join(rows) + ("\n" if i % 2 else "")
        files[f"f {i}+é.csv"] = b"\xfe\xff" + text.encode("utf-16-be") if encoding == "utf-16-be" else text.encode(encoding)
    whole = files["f 3+é.csv"]
    files |= {"cut-odd.csv": whole[:61], "cut-even.csv": whole[:80], "feed.csv": b"\n", "mark.csv": b"\xef\xbb\xbf",
              "like-a-feed.csv": "﻿a,b\nĊ,ਊ\n1,2\n".encode("utf-16-le"),
              "like-a-feed-be.csv": "﻿a,b\nĊ,ਊ\n1,2".encode("utf-16-be"),
              "mark-not-utf8.csv": b"\xef\xbb\xbfa,b\r\n1,\xff", "no-encoding.csv": b"a,b\n\x81,1", "cr.csv": b"a,b\r1,2", "end-cr.csv": b"a,b\n1,2\r",
              "open.csv": b'a,b\n1,"x\ny', "after.csv": b'a,b\n"x"y,2\n', "open-after.csv": b'a,b\n"x"y,"2\n', "plain-quotes.csv": b'a,b\nx"y"z,q"\n'}
    return files


def shown(catalog):
    frames = (catalog.tables, catalog.columns, catalog.warnings)
    return sorted(repr(sorted(r.asDict(recursive=True).items(), key=repr)) for df in frames for r in df.collect())


def test_catalog_is_that_of_whole_files(spark, tmp_path, small_blocks):
    folder = tmp_path / "a b"
    folder.mkdir()
    for name, content in sample_files().items():
        (folder / name).write_bytes(content)
    found = shown(discover_paths(spark, str(folder)))
    assert B.read_bytes(spark, str(folder)).select("file_id", "block").distinct().count() > len(sample_files())
    whole = spark.read.format("binaryFile").load(str(folder)).select(F.col("path").alias("file_id"), "content")
    assert found == shown(discover_delimited(whole))


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16"])
def test_one_file_of_many_blocks(spark, tmp_path, small_blocks, encoding):
    rng = random.Random(2)
    rows = [[str(i), rng.choice(["x", 'say "hi"', "two\nlines", ";,\t", "end\r\n", "é"]) * rng.randrange(1, 4), f"n{i}"] for i in range(40)]
    out = io.StringIO()
    writer = csv.writer(out, delimiter=";", lineterminator="\n")
    writer.writerows([["id", "text", "name"], *rows])
    path = tmp_path / "one.csv"
    path.write_bytes(out.getvalue().encode(encoding))
    catalog = discover_paths(spark, str(path))
    table = catalog.tables.first()
    assert (table.multi_line, table.row_count, table.encoding, table.file_sha256) == (
        True, 40, encoding, hashlib.sha256(path.read_bytes()).hexdigest())
    [frame] = load_catalog(spark, catalog, {table.file_id: str(path)}).values()
    assert sorted(map(tuple, frame.collect())) == sorted((int(i), t, n) for i, t, n in rows)
    path.write_bytes(path.read_bytes() + b"\n")
    with pytest.raises(ValueError, match="not the catalogued"):
        load_catalog(spark, catalog, {table.file_id: str(path)})


def nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def test_no_task_takes_all_lines_of_a_file(spark, tmp_path, small_blocks):
    """What goes by chunk is dealt out by chunk, and no join by file alone moves lines or cells."""
    (tmp_path / "a.csv").write_bytes("\n".join(f"{i},é" for i in range(60)).encode("utf-16"))
    (tmp_path / "open.csv").write_bytes(b'a,b\n1,"x')
    files, lines = B.list_files(spark, str(tmp_path)), B.read_bytes(spark, str(tmp_path))
    about, text = B.describe(files, lines)
    grid = block_grid(about, text)
    try:
        for name, value in (("adaptive.enabled", "false"), ("autoBroadcastJoinThreshold", "-1")):
            spark.conf.set(f"spark.sql.{name}", value)
        plans = [df._jdf.queryExecution().executedPlan() for df in (B.decoded_as(lines, "utf-16"), grid.select("*"))]
    finally:
        for name in ("adaptive.enabled", "autoBroadcastJoinThreshold"):
            spark.conf.unset(f"spark.sql.{name}")
    by_chunk = [n for n in nodes(plans[0]) if n.nodeName() == "Window" and n.partitionSpec().size() == len(B.CHUNK)]
    assert by_chunk and all(n.child().outputPartitioning().expressions().size() == len(B.CHUNK) for n in by_chunk)
    for join in (n for plan in plans for n in nodes(plan) if n.nodeName() == "SortMergeJoin"):
        sides = [[a.name() for a in (side.output().apply(i) for i in range(side.output().size()))] for side in (join.left(), join.right())]
        assert join.leftKeys().size() > 1 or not {"line", "cells"} & set(sum(sides, [])), sides
    assert sorted((r.file_id[-5:], r.row_idx, r.cells) for r in grid.collect()) == [
        ("a.csv", i + 1, [str(i), "é"]) for i in range(60)] + [("n.csv", None, [])]


def test_texts_are_kept_once(spark, tmp_path):
    """Behind the grid only its records are left, and the dialect is told without the texts."""
    for name, content in sample_files().items():
        (tmp_path / name).write_bytes(content)
    files, lines = B.list_files(spark, str(tmp_path)), stage(B.read_bytes(spark, str(tmp_path)), "lines", compact=True)
    folder = lines.inputFiles()[0].rpartition("/")[0].rpartition("/")[0]
    before = set(Folders(spark).names(folder))
    about, text = B.describe(files, lines)
    grid = block_grid(about, text, last=True)
    after = set(Folders(spark).names(folder))
    assert {name.rpartition("-")[0] for name in before - after} == {"lines"}
    assert {name.rpartition("-")[0] for name in after - before} == {"files", "dialects", "chunk-starts", "records"}
    # Behind a last line end a whole file has a record without cells.
    told = "encoding IS NOT NULL AND (problem IS NOT NULL OR cells <> array())"
    whole = spark.read.format("binaryFile").load(str(tmp_path)).select(F.col("path").alias("file_id"), "content")
    found, want = (sorted(map(str, df.where(told).select(grid.columns).collect())) for df in (grid, csv_grid(whole)))
    assert found == want


def test_hashes_of_files_small_and_large(spark, tmp_path, small_blocks):
    for name, content in sample_files().items():
        (tmp_path / name).write_bytes(content)
    found = {r.file_id.rsplit("/", 1)[1]: r.file_sha256 for r in B.file_hashes(spark, [str(tmp_path)], whole=100).collect()}
    assert found == {name: hashlib.sha256(content).hexdigest() for name, content in sample_files().items()}


def test_folder_of_csv_by_stem(spark, tmp_path):
    (tmp_path / "a 1.csv").write_text("﻿id,note\n1,\"x,y\"\n")
    (tmp_path / "b.CSV").write_text("k\r\n2\r\n")
    (tmp_path / "c.txt").write_text("no\n")
    frames = T.load_csv_folder(spark, str(tmp_path))
    assert {k: [tuple(r) for r in v.collect()] for k, v in frames.items()} == {"a 1": [("1", "x,y")], "b": [("2",)]}
    assert frames["a 1"].columns == ["id", "note"]


def test_a_line_is_parsed_once(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a;b;c;d\n1;2;3;4\na;b;c;d\n;;;\n5;6\n")
    frame = T.read_delimited(spark, str(path), T.CsvLayout(("a", "b", "c", "d"), ";", types=("bigint",) * 4))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv") == 2  # of a line, and of a header
    assert sorted(map(tuple, frame.collect())) == [(1, 2, 3, 4), (5, 6, None, None)]

"""Scans, sources and sinks (A1-A17) over whole tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.functions.encoding import decode_text
from mapweave.operators.discovery import discover_paths
from mapweave.operators.loading import load_catalog
from mapweave.operators.mapping import apply_spec
from mapweave.operators.transducer import block_grid
from mapweave.plans.registry import query
from mapweave.schemas import MappingColumn as MC
from mapweave.session import shared_dir
from mapweave.sources import blocks as B
from mapweave.sources import email as E
from mapweave.sources import files as S
from mapweave.sources import tables as D
from mapweave.sources import tabular as T


@query("a01_folder_scan", """SELECT concat('part=', o_custkey % 20, '/') AS folder, count(*) AS rows, sum(length(o_orderpriority) + length(CAST(o_orderkey AS VARCHAR)) + 2)::BIGINT AS bytes
 FROM orders GROUP BY 1""")
def _(t):
    """Orders written as text files below 20 folders, found again by the scan."""
    base = shared_dir(t.spark, "scan")
    lines = F.concat_ws("|", "o_orderkey", "o_orderpriority")
    t.orders.select(lines.alias("value"), (F.col("o_custkey") % 20).alias("part")).write.partitionBy("part").text(base)
    files = S.scan_folder(t.spark, base)
    folder = F.regexp_extract("path", "(part=[0-9]+/)", 1)
    rows = F.length(F.regexp_replace(F.col("content").cast("string"), "[^\\n]", ""))
    return files.groupBy(folder.alias("folder")).agg(F.sum(rows).cast("bigint").alias("rows"), F.sum("length").alias("bytes"))


# Documents as raw files; the SQL text runs in both engines.
_NAME = """concat('dir/Doc', CAST(doc_id AS STRING), CASE doc_id % 10 WHEN 0 THEN '.CSV' WHEN 1 THEN '.xls' WHEN 2 THEN '.pdf'
 WHEN 3 THEN '.msg' WHEN 4 THEN '.txt' WHEN 5 THEN '.md' WHEN 6 THEN '.docx' WHEN 7 THEN '.bin' WHEN 8 THEN '' ELSE '.eml' END)"""
_TEXT = """CASE WHEN doc_id % 3 = 0 AND doc_id % 10 IN (7, 8) THEN concat('PK', text)
 WHEN doc_id % 3 = 1 AND doc_id % 10 IN (7, 8) THEN concat('%PDF', text) ELSE text END"""
_TYPE = """CASE doc_id % 10 WHEN 0 THEN 'csv' WHEN 1 THEN 'xlsx' WHEN 2 THEN 'pdf' WHEN 3 THEN 'eml' WHEN 4 THEN 'txt' WHEN 5 THEN 'md'
 WHEN 6 THEN 'docx' WHEN 9 THEN 'eml' ELSE CASE doc_id % 3 WHEN 0 THEN 'xlsx' WHEN 1 THEN 'pdf' ELSE 'unknown' END END"""
_MIME = f"""CASE {_TYPE} WHEN 'csv' THEN 'text/csv' WHEN 'xlsx' THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet'
 WHEN 'pdf' THEN 'application/pdf' WHEN 'eml' THEN 'message/rfc822' WHEN 'txt' THEN 'text/plain' WHEN 'md' THEN 'text/markdown'
 WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'application/octet-stream' END"""


def _files(t):
    return t.documents.select("doc_id", "source", F.expr(_NAME).alias("name"),
                              F.encode(F.expr(_TEXT), "UTF-8").alias("content"))


@query("a02_file_type_detection", f"SELECT doc_id, {_NAME} AS name, {_TYPE} AS file_type FROM documents")
def _(t):
    return _files(t).select("doc_id", "name", S.file_type(F.col("name"), F.col("content")).alias("file_type"))


@query("a03_mime_mapping", f"SELECT {_TYPE} AS file_type, {_MIME} AS mime_type, count(*) AS n FROM documents GROUP BY 1, 2")
def _(t):
    kinds = _files(t).select(S.file_type(F.col("name"), F.col("content")).alias("file_type"))
    return kinds.groupBy("file_type", S.mime_type(F.col("file_type")).alias("mime_type")).agg(F.count("*").alias("n"))


@query("a04_content_fingerprint", f"SELECT doc_id, sha256({_TEXT}) AS sha256 FROM documents")
def _(t):
    return _files(t).select("doc_id", S.fingerprint(F.col("content")).alias("sha256"))


@query("a08_load_by_position", """SELECT c_custkey % 5 AS file_id, c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 5 = 4 THEN 'first' || chr(10) || c_mktsegment
 ELSE c_mktsegment END AS note FROM customer""")
def _(t):
    """Five files of customers, read in blocks: title, blank first line, repeated header, UTF-16, line breaks in cells."""
    g = F.col("c_custkey") % 5
    note = F.when(g == 4, F.concat(F.lit('"first\n'), F.col("c_mktsegment"), F.lit('"'))).otherwise(F.col("c_mktsegment"))
    # In the third file half of the customers stand below a second header.
    place = F.when(g == 2, F.xxhash64("c_custkey") % 2 + 1).otherwise(F.lit(2))
    rows = t.customer.where("c_custkey % 5 <> 3").select(
        g.alias("file_id"), place.cast("long").alias("place"), F.col("c_custkey").alias("seq"), F.concat_ws(",", "c_custkey", "c_name", note).alias("value"))
    top = t.spark.createDataFrame([(0, -3, 0, "Customer list"), (0, -2, 0, ""), (1, -2, 0, ""), *((i, -1, 0, "id,name,note") for i in (0, 1, 2, 4)),
                                   (2, 1, 1 << 62, "id,name,note")], "file_id long, place long, seq long, value string")
    base = shared_dir(t.spark, "layouts")
    lines = rows.union(top).repartition("file_id").sortWithinPartitions("file_id", "place", "seq")
    lines.select("file_id", "value").write.partitionBy("file_id").text(base)
    wide = t.customer.where("c_custkey % 5 = 3").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("note"))
    wide.repartition(1).write.option("header", True).option("encoding", "UTF-16").csv(f"{base}/file_id=3")
    catalog = discover_paths(t.spark, f"{base}/file_id=*")
    files = {r.source_table_id: r.file_id for r in catalog.tables.select("source_table_id", "file_id").toLocalIterator()}
    frames = load_catalog(t.spark, catalog, {path: path for path in files.values()})
    number = {k: int(re.search("file_id=([0-9])", path)[1]) for k, path in files.items()}
    parts = [df.select(F.lit(number[k]).cast("bigint").alias("file_id"), "id", "name", "note") for k, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)


@query("b03_block_encoding", """WITH d AS (SELECT doc_id % 3 AS k, text, regexp_matches(text, '[^\x00-\x7F]') AS wide FROM documents)
SELECT k, CASE k WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16' ELSE CASE WHEN bool_or(wide) THEN 'cp1252' ELSE 'utf-8' END END AS encoding,
 CASE WHEN bool_or(contains(text, chr(13) || chr(10))) THEN 'CRLF' WHEN bool_or(contains(text, chr(13))) THEN 'CR' ELSE 'LF' END AS newline,
 count(*) + 1 AS records, sum(length(text))::BIGINT AS chars FROM d GROUP BY k""")
def _(t):
    """Documents as three delimited files in three encodings: what a file is, told from its blocks, and its records."""
    base = shared_dir(t.spark, "encodings")
    with D.brief_shuffles(t.spark):
        for k, encoding in enumerate(("UTF-8", "UTF-16", "ISO-8859-1")):
            (t.documents.where(F.col("doc_id") % 3 == k).select("doc_id", "text").repartition(1).write.option("header", True)
             .option("escape", '"').option("quoteAll", True).option("encoding", encoding)
             .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{base}/k={k}"))
    files, lines = B.list_files(t.spark, f"{base}/k=*"), D.stage(B.read_bytes(t.spark, f"{base}/k=*"), "lines", compact=True)
    about, text = B.describe(files, lines)
    grid = block_grid(about, text, last=True)
    k = F.regexp_extract("file_id", "k=([0-9])", 1).cast("bigint").alias("k")
    chars = F.when(F.col("row_idx") > 1, F.length(F.get("cells", F.lit(1))))
    return grid.groupBy(k, "encoding", "newline").agg(F.count("*").alias("records"), F.sum(chars).alias("chars"))


_KEY = f"concat('acme/', source, '/', substring(sha256({_TEXT}), 1, 16), '_', replace({_NAME}, '/', '_'))"


@query("a05_storage_key", f"SELECT doc_id, {_KEY} AS storage_key FROM documents")
def _(t):
    return _files(t).select("doc_id", S.storage_key(
        F.lit("acme"), F.col("source"), F.col("name"), S.fingerprint(F.col("content"))).alias("storage_key"))


@query("a06_raw_file_registry", f"""SELECT 'acme' AS client, source AS batch, {_NAME} AS original_filename, sha256({_TEXT}) AS sha256,
 CAST(octet_length(encode({_TEXT})) AS BIGINT) AS size_bytes, {_TYPE} AS file_type, {_MIME} AS mime_type, {_KEY} AS storage_key,
 'uploaded' AS status FROM documents""")
def _(t):
    path = shared_dir(t.spark, "registry")
    rows = S.registry_rows(_files(t), F.lit("acme"), F.col("source"))
    D.append(rows, path)
    return t.spark.read.schema(rows.schema).parquet(path)


@query("a07_ingest_summary", """SELECT source AS batch, count(*) AS files, count(quality) FILTER (WHERE quality = 1) AS parsed_count,
 count(*) FILTER (WHERE quality = 0) AS failed_count FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def _(t):
    status = (F.when(F.col("quality") == 1, "parsed").when(F.col("quality") == 0, "failed").otherwise("uploaded"))
    files = t.documents.select("doc_id", F.col("source").alias("batch")).join(t.labels, "doc_id", "left")
    return S.ingest_summary(files.withColumn("status", status), "batch")


def _orders_csv(t, sep=";"):
    """Orders as delimited text with quoted cells, in the shared folder."""
    path = shared_dir(t.spark, "orders") + ".csv"
    (t.orders.select("o_orderkey", "o_custkey", F.concat(F.lit('say "'), "o_orderpriority", F.lit(f'"{sep}')).alias("note"),
                     "o_totalprice", F.date_format("o_orderdate", "d/M/yyyy").alias("date"))
     .write.option("header", True).option("sep", sep).option("escape", '"').csv(path))
    return path


@query("a08_catalog_csv_scan", """SELECT o_orderkey AS order_id, o_custkey AS cust_id, 'say "' || o_orderpriority || '";' AS note,
 o_totalprice AS price, CAST(NULL AS VARCHAR) AS missing FROM orders""")
def _(t):
    layout = T.CsvLayout(("order_id", "cust_id", "note", "price", "date", "missing"), ";",
                         types=("bigint", "bigint", "string", "double", "string", "string"))
    return T.read_delimited(t.spark, _orders_csv(t), layout).drop("date")


# Customers as sheets of 50 rows: title, header, data, blank rows, repeated headers.
_GRID = """SELECT CAST(floor(c_custkey / 50) AS BIGINT) AS sheet, c_custkey % 50 + 1 AS row_idx, CASE
 WHEN c_custkey % 50 = 0 THEN array('Customer export') WHEN c_custkey % 50 = 1 OR c_custkey % 25 = 13 THEN array('', ' id', 'name', 'note')
 WHEN c_custkey % 50 = 20 THEN array('', '', NULL) WHEN c_custkey % 7 = 3 THEN array('', CAST(c_custkey AS STRING), c_name)
 ELSE array('', CAST(c_custkey AS STRING), c_name, c_mktsegment, 'extra') END AS cells FROM customer"""


@query("a09_region_scan", """SELECT c_custkey % 50 + 1 AS row_idx, CAST(c_custkey AS VARCHAR) AS id, c_name AS name,
 CASE WHEN c_custkey % 7 = 3 THEN NULL ELSE c_mktsegment END AS note FROM customer
 WHERE c_custkey % 50 BETWEEN 2 AND 47 AND c_custkey % 50 <> 20 AND c_custkey % 25 <> 13""")
def _(t):
    t.customer.createOrReplaceTempView("customer")
    return T.grid_region(t.spark.sql(_GRID), ["id", "name", "note"], ["id", "name", "note"], (2, 48), (2, 4))


@query("a10_multi_source_load", """SELECT o_orderkey AS order_id, c_name AS customer, n.total FROM orders LEFT JOIN customer ON o_custkey = c_custkey
 LEFT JOIN (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total FROM orders GROUP BY 1) n USING (o_custkey)""")
def _(t):
    customers = shared_dir(t.spark, "customers") + ".csv"
    t.customer.select("c_custkey", "c_name").write.option("header", True).csv(customers)
    layouts = {
        "t-orders": T.CsvLayout(("order_id", "cust_id", "note", "price", "date"), ";",
                                types=("bigint", "bigint", "string", "double", "string")),
        "t-customers": T.CsvLayout(("cust_id", "name"), types=("bigint", "string"))}
    sources = T.load_sources(t.spark, layouts, {"t-orders": _orders_csv(t), "t-customers": customers})
    key = (("t-orders", "cust_id"),)
    spec = [MC("o", "order_id", source_columns=(("t-orders", "order_id"),)),
            MC("o", "customer", "lookup", key, lookup_table="t-customers", lookup_key="cust_id", lookup_value="name", sort_order=1),
            MC("o", "total", "aggregation", key, aggregation_table="t-orders", aggregation_key="cust_id",
               aggregation_expression="cast(sum(cast(price AS decimal(18,4))) AS double)", sort_order=2)]
    return apply_spec(spec, sources)["o"]


_CATALOGUED = f"""SELECT concat('t', CAST(doc_id AS STRING)) AS source_table_id, CASE WHEN doc_id % 4 = 0 THEN 'gone.csv' ELSE {_NAME} END AS original_filename,
 concat('r', CAST(doc_id AS STRING)) AS raw_file_id, CASE WHEN doc_id % 5 = 0 THEN sha256('other') WHEN doc_id % 5 = 1 THEN '' ELSE sha256({_TEXT}) END AS file_sha256
 FROM documents"""
_STORED = f"""SELECT {_NAME} AS name, sha256({_TEXT}) AS sha256 FROM documents WHERE doc_id % 7 > 0
 UNION ALL SELECT concat('r', CAST(doc_id AS STRING), '_copy.csv'), sha256({_TEXT}) FROM documents WHERE doc_id % 6 = 0"""


@query("a11_source_integrity", f"""WITH c AS ({_CATALOGUED}), f AS ({_STORED}),
m AS (SELECT source_table_id, name, sha256 FROM c JOIN f ON original_filename = name
 UNION SELECT source_table_id, name, sha256 FROM c JOIN f ON starts_with(name, raw_file_id || '_')),
n AS (SELECT source_table_id, count(*) AS n, min(name) AS name, min(sha256) AS sha256 FROM m GROUP BY 1)
SELECT source_table_id, CASE WHEN n = 1 THEN name END AS name, CASE WHEN coalesce(n, 0) <> 1 THEN 'expected one file, found ' || coalesce(n, 0)
 WHEN file_sha256 <> '' AND file_sha256 <> sha256 THEN 'content hash mismatch' END AS problem FROM c LEFT JOIN n USING (source_table_id)""")
def _(t):
    t.documents.createOrReplaceTempView("documents")
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION sha256(s STRING) RETURNS STRING RETURN sha2(s, 256)")
    return S.resolve_files(t.spark.sql(_CATALOGUED), t.spark.sql(_STORED))


@query("a12_csv_folder_by_stem", """SELECT 'orders' AS stem, o_orderkey AS id, o_orderstatus AS label FROM orders
UNION ALL SELECT 'customer', c_custkey, c_mktsegment FROM customer""")
def _(t):
    folder = shared_dir(t.spark, "stems")
    paths = T.write_targets({"orders.csv": t.orders.selectExpr("o_orderkey AS id", "o_orderstatus AS label"),
                             "customer.csv": t.customer.selectExpr("c_custkey AS id", "c_mktsegment AS label")}, folder)
    frames = {}
    for path in paths.values():
        frames.update({f"{path.rsplit('/', 1)[-1][:-4]}/{k}": v for k, v in T.load_csv_folder(t.spark, path).items()})
    out = None
    for key, df in sorted(frames.items()):
        rows = df.select(F.lit(key.split("/")[0]).alias("stem"), F.col("id").cast("bigint").alias("id"), "label")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("a13_csv_sink", """SELECT tag, p_partkey AS sku, p_name AS name, p_retailprice AS price FROM part, (SELECT unnest(['products', 'results']) AS tag)""")
def _(t):
    out = t.part.selectExpr("p_partkey AS sku", "p_name AS name", "p_retailprice AS price")
    paths = T.write_targets({"products": out}, shared_dir(t.spark, "sink"))
    layout = T.CsvLayout(("sku", "name", "price"), types=("bigint", "string", "double"))
    read = [T.read_delimited(t.spark, p, layout).withColumn("tag", F.lit(n)) for n, p in paths.items()]
    return read[0].unionByName(read[1])


@query("a14_target_contract_json", """SELECT p_brand AS target_table, 'c' || p_partkey AS target_column, 0 AS pos, 'Int64' AS dtype, p_size % 2 = 0 AS required,
 false AS "unique", CASE WHEN p_size % 3 = 0 THEN p_name || '|' || p_type ELSE '' END AS allowed FROM part
UNION ALL SELECT p_brand, 'd' || p_partkey, 1, NULL, false, true, '' FROM part""")
def _(t):
    path = shared_dir(t.spark, "contracts")
    doc = F.to_json(F.struct(F.array(F.struct(F.col("p_brand").alias("name"), F.array(
        F.struct(F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("name"), F.lit("Int64").alias("dtype"),
                 F.when(F.col("p_size") % 2 == 0, True).alias("required"), F.lit(None).cast("boolean").alias("unique"),
                 F.when(F.col("p_size") % 3 == 0, F.array("p_name", "p_type")).alias("allowed_values")),
        F.struct(F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("name"), F.lit(None).cast("string").alias("dtype"),
                 F.lit(None).cast("boolean").alias("required"), F.lit(True).alias("unique"),
                 F.lit(None).cast("array<string>").alias("allowed_values"))).alias("columns"))).alias("tables")))
    t.part.select(doc.alias("value")).write.text(path)
    rows = T.read_contracts(t.spark, path, multi_line=False)
    return rows.withColumn("allowed", F.array_join("allowed_values", "|")).drop("allowed_values")


@query("a15_run_log_merge", """SELECT user_id AS run_id, k AS field, arg_max(v, event_id) AS value FROM (
 SELECT user_id, event_id, 'status' AS k, event_type AS v FROM events UNION ALL
 SELECT user_id, event_id, 'amount', CAST(value AS VARCHAR) FROM events WHERE value > 5) GROUP BY 1, 2""")
def _(t):
    path = shared_dir(t.spark, "run-log")
    updates = t.events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("at"), F.col("event_type").alias("status"),
                              F.when(F.col("value") > 5, F.col("value").cast("string")).alias("amount"))
    D.append(T.log_entries(updates, "run_id", "at"), path)
    log = t.spark.read.schema("run_id bigint, at bigint, entry string").parquet(path)
    return T.merge_log(log, "run_id", "at")


@query("a16_email_table", """SELECT conv_id, turn, 'u' || conv_id || '@example.com' AS sender, 'Turn ' || turn || ' of thread' AS subject,
 text AS body_text FROM conversations""")
def _(t):
    head = F.concat(F.lit("From: u"), F.col("conv_id").cast("string"), F.lit("@example.com\r\nSubject: old\r\nSubject: Turn "),
                    F.col("turn").cast("string"), F.lit("\r\n of thread\r\n"))
    body = (F.when(F.col("turn") % 3 == 1, F.concat(F.lit("Content-Transfer-Encoding: base64\r\n\r\n"), F.base64(F.encode("text", "UTF-8"))))
            .when(F.col("turn") % 3 == 2, F.concat(
                F.lit("Content-Transfer-Encoding: quoted-printable\r\n\r\n"),
                F.regexp_replace(F.hex(F.encode("text", "UTF-8")), "(..)", "=$1")))
            .otherwise(F.concat(F.lit("\r\n"), "text")))
    messages = t.conversations.select("conv_id", "turn", F.concat(head, body).alias("raw"))
    parsed = E.parse_messages(messages)
    return parsed.select("conv_id", "turn", E.header_value(F.col("headers"), "From").alias("sender"),
                         E.header_value(F.col("headers"), "Subject").alias("subject"), "body_text")


@query("a17_text_decode", "SELECT doc_id, sha256(text) AS text_sha, CAST(length(text) AS BIGINT) AS n FROM documents")
def _(t):
    damaged = F.concat(F.unhex(F.lit("FF")), F.encode("text", "UTF-8"), F.unhex(F.lit("C3")))
    text = decode_text(damaged)
    return t.documents.select("doc_id", F.sha2(text, 256).alias("text_sha"), F.length(text).cast("bigint").alias("n"))

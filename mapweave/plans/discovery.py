"""Discovery over cell grids (B1-B18) over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapweave.functions import ids as I
from mapweave.operators import catalog as C
from mapweave.operators import dialect as L
from mapweave.operators import grid as G
from mapweave.operators.ordered import running_count
from mapweave.plans.registry import query


def _sql(t, text, *tables):
    for name in tables:
        getattr(t, name).createOrReplaceTempView(name)
    return t.spark.sql(text)


@query("b01_column_name_normalisation", """SELECT doc_id, sha256(coalesce(nullif(regexp_replace(regexp_replace(lower(text), '[^0-9a-z]+', '_', 'g'),
 '^_+|_+$', '', 'g'), ''), 'column_' || (doc_id + 1))) AS name_sha FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN ' -- ' ELSE text END AS text FROM documents)""")
def _(t):
    headers = t.documents.select("doc_id", F.lit(1).alias("t"), (F.col("doc_id") + 1).alias("ordinal"),
                                 F.when(F.col("doc_id") % 9 == 0, " -- ").otherwise(F.col("text")).alias("header"))
    from mapweave.functions.scalar import normalize_name
    from mapweave.functions.text import nfkc
    return headers.select("doc_id", F.sha2(normalize_name(nfkc(F.col("header")), F.col("ordinal")), 256).alias("name_sha"))


# A third of all header cells sit in one table.
_HEADERS = """SELECT CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE CAST(floor(p_partkey / 50) AS BIGINT) END AS table_no, p_partkey AS ordinal,
 CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE concat(' ', p_name, '?') END AS header FROM part"""


@query("b02_duplicate_names", f"""WITH h AS ({_HEADERS}), n AS (SELECT *, trim(coalesce(header, '')) AS original,
 coalesce(nullif(regexp_replace(regexp_replace(lower(coalesce(header, '')), '[^0-9a-z]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'column_' || ordinal) AS name FROM h),
k AS (SELECT *, row_number() OVER (PARTITION BY table_no, name ORDER BY ordinal) AS k FROM n)
SELECT table_no, ordinal, CASE WHEN original = '' THEN 'Column ' || ordinal ELSE original END AS original_name,
 CASE WHEN k > 1 THEN name || '_' || k ELSE name END AS normalized_name,
 CASE WHEN k > 1 THEN 'Duplicate column name ''' || coalesce(nullif(original, ''), name) || ''' was renamed.' END AS warning FROM k""")
def _(t):
    return G.normalized_headers(_sql(t, _HEADERS, "part"), ["table_no"])


@query("b03_encoding_detection", """WITH d AS (SELECT doc_id, doc_id % 5 AS k, text, to_hex(encode(text)) AS h FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN 'utf-8-sig' WHEN 1 THEN 'utf-8' WHEN 3 THEN 'utf-16' WHEN 4 THEN 'cp1252'
 ELSE CASE WHEN regexp_matches(h, '^(?:..)*(?:81|8D|8F|90|9D)') THEN NULL ELSE 'cp1252' END END AS encoding,
 CASE WHEN k IN (0, 1, 3) THEN sha256(text) END AS text_sha FROM d""")
def _(t):
    k, utf8 = F.col("doc_id") % 5, F.encode("text", "UTF-8")
    content = (F.when(k == 0, F.concat(F.unhex(F.lit("EFBBBF")), utf8)).when(k == 1, utf8)
               .when(k == 2, F.concat(F.unhex(F.lit("E9")), utf8)).when(k == 3, F.encode("text", "UTF-16"))
               .otherwise(F.unhex(F.lit("FFFE41"))))
    found = t.documents.select("doc_id", content.alias("content")).withColumn("encoding", L.encoding(F.col("content")))
    text = L.decode(F.col("content"), F.col("encoding"))
    return found.select("doc_id", "encoding", F.when(F.col("doc_id") % 5 < 4, F.when(
        F.col("doc_id") % 5 != 2, F.sha2(text, 256))).alias("text_sha"))


@query("b04_newline_style", """SELECT doc_id, CASE WHEN contains(text, chr(10)) THEN CASE doc_id % 3 WHEN 0 THEN 'CRLF' WHEN 1 THEN 'CR' ELSE 'LF' END
 ELSE 'LF' END AS newline FROM documents""")
def _(t):
    text = (F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n")))
            .when(F.col("doc_id") % 3 == 1, F.replace("text", F.lit("\n"), F.lit("\r"))).otherwise(F.col("text")))
    return t.documents.select("doc_id", L.newline_style(text).alias("newline"))


# Documents as delimited files: commas become other delimiters, some cells are quoted.
_DELIMITED = """SELECT doc_id, replace(CASE WHEN doc_id % 6 = 5 THEN concat('"', replace(text, '"', ''), '"', chr(10), text) ELSE text END, ', ',
 CASE doc_id % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE '|' END) AS text FROM documents"""


@query("b05_delimiter_detection", f"""WITH f AS ({_DELIMITED}), d AS (SELECT * FROM (VALUES (',', ',', 0), (';', ';', 1), (chr(9), chr(9), 2), ('|', '\\|', 3)) v(d, e, r)),
m AS (SELECT doc_id, d, r, e, regexp_replace(text, '(^|[' || e || '\\r\\n])"[^"]*(?:""[^"]*)*"', '\\1' || chr(57344), 'g') AS masked FROM f, d),
ok AS (SELECT * FROM m WHERE NOT regexp_matches(masked, '(^|[' || e || '\\r\\n])"') AND NOT regexp_matches(masked, chr(57344) || '[^' || e || '\\r\\n]')),
w AS (SELECT doc_id, d, r, len(x) - len(replace(x, d, '')) + 1 AS width FROM (SELECT doc_id, d, r, unnest(string_split(masked, chr(10))) AS x FROM ok) WHERE x <> ''),
n AS (SELECT doc_id, d, r, width, count(*) AS n FROM w WHERE width > 1 GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, width DESC, r) AS k FROM n)
SELECT doc_id, coalesce(d, ',') AS delimiter, d IS NULL AS fallback FROM f LEFT JOIN (SELECT doc_id, d FROM b WHERE k = 1) USING (doc_id)""")
def _(t):
    found = L.delimiter(F.col("text"))
    return (_sql(t, _DELIMITED, "documents").select("doc_id", found.alias("d"))
            .select("doc_id", F.coalesce("d", F.lit(",")).alias("delimiter"), F.col("d").isNull().alias("fallback")))


# Orders as grid rows; one file holds a third of them.
_GRID = """SELECT CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey % 50 + 1 END AS file_id, o_orderkey + 1 AS row_idx, CASE
 WHEN o_orderkey % 29 = 3 THEN array('', NULL, '') WHEN o_orderkey % 31 = 5 THEN array('order', 'customer', 'priority')
 WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 0 THEN array(CAST(o_orderkey AS STRING), CAST(o_custkey AS STRING))
 WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN array(CAST(o_orderkey AS STRING), '', o_orderpriority, o_orderstatus)
 ELSE array(CAST(o_orderkey AS STRING), CAST(o_custkey AS STRING), o_orderpriority) END AS cells FROM orders"""
_DUCK_GRID = _GRID.replace("array(", "list_value(")
_FILLED = "list_filter(cells, lambda x: x IS NOT NULL AND x <> '')"


@query("b06_modal_width_and_ragged_rows", f"""WITH g AS ({_DUCK_GRID}), p AS (SELECT * FROM g WHERE len({_FILLED}) > 0),
n AS (SELECT file_id, len(cells) AS w, count(*) AS n, min(row_idx) AS seen FROM p GROUP BY 1, 2),
m AS (SELECT file_id, w FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, seen) AS r FROM n) WHERE r = 1),
o AS (SELECT g.file_id, m.w, row_idx, row_number() OVER (PARTITION BY g.file_id ORDER BY row_idx) AS r FROM g JOIN m ON g.file_id = m.file_id AND len(cells) <> m.w)
SELECT file_id, w AS width, count(*) AS ragged, string_agg(row_idx, ',' ORDER BY row_idx) FILTER (WHERE r <= 20) AS rows FROM o GROUP BY 1, 2""")
def _(t):
    odd = G.ragged_rows(_sql(t, _GRID, "orders"), ["file_id"])
    return odd.select("file_id", F.col("width").cast("bigint").alias("width"), "ragged", F.array_join("rows", ",").alias("rows"))


@query("b06_all_ragged_rows", f"""WITH g AS ({_DUCK_GRID}), p AS (SELECT * FROM g WHERE len({_FILLED}) > 0),
n AS (SELECT file_id, len(cells) AS w, count(*) AS n, min(row_idx) AS seen FROM p GROUP BY 1, 2),
m AS (SELECT file_id, w FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, seen) AS r FROM n) WHERE r = 1)
SELECT g.file_id, m.w AS width, row_idx, len(cells) AS row_width FROM g JOIN m ON g.file_id = m.file_id AND len(cells) <> m.w""")
def _(t):
    odd = G.ragged_row_numbers(_sql(t, _GRID, "orders"), ["file_id"])
    return odd.select("file_id", F.col("width").cast("bigint").alias("width"), "row_idx", F.col("row_width").cast("bigint").alias("row_width"))


_PLACED = f"g AS ({_DUCK_GRID}), p AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY row_idx) - 1 AS pos FROM g WHERE len({_FILLED}) > 0)"
_SCORED = _PLACED + f""", s AS (SELECT *, len({_FILLED}) AS n, len(list_distinct({_FILLED})) AS u FROM p WHERE pos < 15),
f AS (SELECT *, max(n) OVER (PARTITION BY file_id ORDER BY pos RANGE BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS nx FROM s),
h AS (SELECT file_id, pos, row_idx, cells, CAST(0.5 AS DOUBLE) * 1.0 + CAST(0.3 AS DOUBLE) * (CAST(u AS DOUBLE) / n) + CAST(0.2 AS DOUBLE) *
 least(CAST(1.0 AS DOUBLE), CAST(n AS DOUBLE) / greatest(1, coalesce(nx, 0))) AS score FROM f WHERE pos < 10),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, pos) AS r FROM h) WHERE r = 1)"""


def _placed(t):
    grid = _sql(t, _GRID, "orders").where(G.populated("cells"))
    return running_count(grid, ["file_id"], "row_idx", "_n").withColumn("pos", F.col("_n") - 1).drop("_n")


@query("b07_header_row_scoring", f"""WITH {_SCORED} SELECT file_id, pos AS header_pos, row_idx AS header_row, round(score, 6) AS score,
 array_to_string(cells, '|') AS header FROM b""")
def _(t):
    best = G.header_rows(_placed(t), ["file_id"], "pos")
    return best.select("file_id", "header_pos", "header_row", F.round("score", 6).alias("score"),
                       F.array_join("header", "|").alias("header"))


@query("b08_pad_rows", f"""WITH g AS ({_DUCK_GRID}) SELECT file_id, row_idx, cells[1] AS a, cells[2] AS b, cells[3] AS c,
 CAST(3 AS BIGINT) AS width FROM g""")
def _(t):
    padded = G.pad(F.col("cells"), 3)
    return _sql(t, _GRID, "orders").select("file_id", "row_idx", padded[0].alias("a"), padded[1].alias("b"),
                                           padded[2].alias("c"), F.size(padded).cast("bigint").alias("width"))


_REST = f"""q AS (SELECT g.file_id, g.cells, g.row_idx, b.cells AS header, b.row_idx AS hrow, b.pos AS hpos FROM g JOIN b ON g.file_id = b.file_id)"""


@query("b09_drop_blank_and_repeated_rows", f"""WITH {_SCORED}, {_REST} SELECT file_id, any_value(hpos) AS preamble,
 count(*) FILTER (WHERE row_idx > hrow AND len({_FILLED}) = 0) AS blank, count(*) FILTER (WHERE row_idx > hrow AND cells = header) AS repeated,
 count(*) FILTER (WHERE row_idx > hrow AND len({_FILLED}) > 0 AND cells <> header) AS kept,
 CAST(sum(row_idx) FILTER (WHERE row_idx > hrow AND len({_FILLED}) > 0 AND cells <> header) AS BIGINT) AS kept_rows FROM q GROUP BY 1""")
def _(t):
    grid, keys = _sql(t, _GRID, "orders"), ["file_id"]
    best = G.header_rows(_placed(t), keys, "pos")
    # Places count populated rows, so blank rows are placed by row number.
    by_row = best.withColumns({"preamble": F.col("header_pos"), "header_pos": F.col("header_row")})
    dropped = G.dropped_rows(grid, by_row, keys, "row_idx").drop("preamble")
    kept = G.data_rows(grid, by_row, keys, "row_idx").groupBy("file_id").agg(
        F.count("*").alias("kept"), F.sum("row_idx").alias("kept_rows"))
    return by_row.select("file_id", "preamble").join(dropped, keys).join(kept, keys)


# Events as sheet rows: a third in one sheet; rows of other sheets are gaps.
_SHEETS = """SELECT CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id % 4 + 1 END AS sheet, event_id + 1 AS row_idx,
 CASE WHEN event_type = 'error' THEN array('', NULL, '', '') WHEN event_type = 'view' THEN array('', event_type)
 WHEN event_type = 'click' THEN array(NULL, event_type, CAST(user_id AS STRING), '') ELSE array('', '', CAST(event_id AS STRING), event_type) END AS cells FROM events"""
_ISLANDS = f"""g AS ({_SHEETS.replace("array(", "list_value(")}), p AS (SELECT * FROM g WHERE len({_FILLED}) > 0),
s AS (SELECT *, CASE WHEN row_idx - lag(row_idx) OVER (PARTITION BY sheet ORDER BY row_idx) <= 2 THEN 0 ELSE 1 END AS fresh FROM p),
r AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY sheet ORDER BY row_idx) AS BIGINT) AS region FROM s)"""


@query("b10_table_regions", f"WITH {_ISLANDS} SELECT sheet, row_idx, region FROM r")
def _(t):
    return G.with_regions(_sql(t, _SHEETS, "events"), ["sheet"], chunk_rows=4096).select("sheet", "row_idx", "region")


@query("b11_region_bounds", f"""WITH {_ISLANDS}, c AS (SELECT sheet, region, row_idx, unnest(cells) AS v, unnest(range(1, len(cells) + 1)) AS i FROM r),
b AS (SELECT sheet, region, min(row_idx) AS min_row, max(row_idx) AS max_row, min(i) AS min_col, max(i) AS max_col FROM c WHERE v <> '' GROUP BY 1, 2)
SELECT sheet, region, chr(CAST(64 + min_col AS INTEGER)) || min_row || ':' || chr(CAST(64 + max_col AS INTEGER)) || max_row AS cell_range,
 min_row = max_row AND min_col = max_col AS is_title FROM b""")
def _(t):
    bounds = G.regions(G.with_regions(_sql(t, _SHEETS, "events"), ["sheet"]), ["sheet"])
    where = G.cell_range(F.col("min_col"), F.col("min_row"), F.col("max_col"), F.col("max_row"))
    return bounds.select("sheet", "region", where.alias("cell_range"), "is_title")


_LEFT = """SELECT CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_suppkey % 100 END AS sheet,
 l_orderkey * 10000000000 + l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS left_id, l_orderkey AS min_row,
 l_orderkey + l_linenumber * l_linenumber AS max_row, l_linenumber AS min_col, l_linenumber + 2 AS max_col FROM lineitem"""
_RIGHT = """SELECT CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey % 100 END AS sheet, o_orderkey AS right_id, o_orderkey AS min_row,
 o_orderkey + o_custkey % 4 AS max_row, o_custkey % 5 AS min_col, o_custkey % 5 + 1 AS max_col FROM orders"""


@query("b12_rectangle_overlap", f"""WITH a AS ({_LEFT}), b AS ({_RIGHT}) SELECT a.sheet, left_id, right_id FROM a JOIN b ON a.sheet = b.sheet
 AND a.min_row <= b.max_row AND b.min_row <= a.max_row AND a.min_col <= b.max_col AND b.min_col <= a.max_col""")
def _(t):
    return G.overlaps(_sql(t, _LEFT, "lineitem"), _sql(t, _RIGHT, "orders"), ["sheet"])


def _duck_uuid5(name):
    h = f"sha1(unhex('{I.SOURCE_NAMESPACE.hex}') || encode({name}))"
    variant = f"substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1)"
    return (f"list_transform([{h}], lambda h: substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||{variant}"
            f"||substr(h,18,3)||'-'||substr(h,21,12))[1]")


_TABLE_NAME = "sha256(text) || '|' || source || '|A1:C9|' || (doc_id % 7) || '|id,name'"


@query("b13_stable_ids", f"""WITH d AS (SELECT doc_id, {_duck_uuid5(_TABLE_NAME)} AS source_table_id FROM documents)
SELECT doc_id, source_table_id, {_duck_uuid5("source_table_id || '|1|name'")} AS source_column_id FROM d""")
def _(t):
    table = I.table_id(F.sha2("text", 256), F.col("source"), F.lit("A1:C9"), F.col("doc_id") % 7,
                       F.array(F.lit("id"), F.lit("name")))
    tables = t.documents.select("doc_id", table.alias("source_table_id"))
    return tables.withColumn("source_column_id", I.column_id(F.col("source_table_id"), F.lit(1), F.lit("name")))


@query("b14_discovery_confidence", """SELECT event_id, CASE WHEN event_type = 'error' THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.95 AS DOUBLE) END AS csv_confidence,
 greatest(CAST(0.4 AS DOUBLE), least(CAST(0.99 AS DOUBLE), value / 40)) AS grid_confidence FROM events""")
def _(t):
    warnings = F.when(F.col("event_type") == "error", 2).otherwise(0)
    return t.events.select("event_id", G.csv_confidence(warnings).alias("csv_confidence"),
                           G.grid_confidence(F.col("value") / 40).alias("grid_confidence"))


# Catalog documents of the three shapes, one per part.
_TABLE_JSON = """concat('{"source_table_id":"t', CAST(p_partkey AS STRING), '","original_filename":"', p_brand, '.csv","display_name":"', p_name,
 '","location":{"sheet_name":"s1","header_row":2},"row_count":', CAST(p_size AS STRING), ',"warnings":[{"code":"ragged_rows","message":"', CAST(p_size AS STRING),
 ' rows"}],"columns":[{"normalized_name":"', p_type, '","inferred_type":"string"},{"header":"H', CAST(p_size AS STRING), '"},{"column":"x","dtype":"Int64"}]}')"""
_CATALOG_JSON = f"""SELECT p_partkey AS catalog_id, p_brand AS original_filename, CASE p_partkey % 3
 WHEN 0 THEN concat('{{"file_type":"csv","warnings":[{{"code":"encoding_fallback","message":"m"}}],"tables":[', {_TABLE_JSON}, ',', {_TABLE_JSON}, ']}}')
 WHEN 1 THEN concat('{{"sheets":[', {_TABLE_JSON}, ']}}') ELSE {_TABLE_JSON} END AS catalog_json FROM part"""
_FLAT = "(SELECT *, unnest(range(0, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END)) AS tp FROM part)"


def _catalog_tables(t):
    docs = _sql(t, _CATALOG_JSON, "part").withColumnRenamed("original_filename", "catalog_file")
    return C.catalog_tables(docs)


@query("b15_warning_stream", f"""SELECT p_brand AS source, 'encoding_fallback' AS code, 'm' AS message FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_name, 'ragged_rows', p_size || ' rows' FROM {_FLAT}""")
def _(t):
    from mapweave.schemas import CATALOG
    docs = _sql(t, _CATALOG_JSON, "part").select("original_filename", F.from_json("catalog_json", CATALOG).alias("c"))
    # A bare table carries its own warnings; only real catalogs have catalog warnings.
    catalogs = docs.where("c.tables IS NOT NULL OR c.sheets IS NOT NULL").select("original_filename", "c.warnings")
    return G.warning_stream(_catalog_tables(t), catalogs).select("source", "code", "message")


@query("b16_catalog_flatten", f"""SELECT p_partkey AS catalog_id, CAST(tp AS INTEGER) AS table_pos, CAST(cp AS INTEGER) AS column_pos, p_brand || '.csv' AS original_filename, p_name AS display_name,
 's1' AS sheet_name, CAST(p_size AS BIGINT) AS row_count, CASE cp WHEN 0 THEN p_type WHEN 1 THEN 'H' || p_size ELSE 'x' END AS column_name,
 CASE cp WHEN 0 THEN 'string' WHEN 2 THEN 'Int64' END AS inferred_type FROM {_FLAT}, range(0, 3) r(cp)""")
def _(t):
    return C.catalog_columns(_catalog_tables(t)).select(
        "catalog_id", "table_pos", "column_pos", "original_filename", "display_name", "sheet_name", "row_count",
        "column_name", "inferred_type")


_QUOTED = """SELECT doc_id, concat('id,text', chr(10), '1,"', replace(text, '"', '""'), CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '" x' ELSE '"' END,
 CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat(chr(10), '2,ok', CASE WHEN doc_id % 4 = 2 THEN concat(chr(13), 'z') ELSE '' END) END) AS text FROM documents"""


@query("b17_malformed_quotes", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'unexpected end of data in a quoted cell' WHEN 1 THEN 'text after a closing quote'
 WHEN 2 THEN 'new-line character in an unquoted cell' END AS problem FROM documents""")
def _(t):
    return _sql(t, _QUOTED, "documents").select("doc_id", L.quote_problem(F.col("text"), F.lit(",")).alias("problem"))


@query("b18_empty_sources", """SELECT c_custkey AS file_id, 'contains no table data' AS warning FROM customer
 WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P')""")
def _(t):
    grid = t.orders.select(F.col("o_custkey").alias("file_id"), F.array(
        F.lit(""), F.nullif("o_orderstatus", F.lit("P"))).alias("cells"))
    return G.empty_sources(t.customer.select(F.col("c_custkey").alias("file_id")), grid, ["file_id"])

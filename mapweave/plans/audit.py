"""Audit, lineage, run metadata and kept state (G1-G14) over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapweave.operators import audit as A
from mapweave.operators import lineage as L
from mapweave.operators.nesting import join_text, nest
from mapweave.plans.registry import query
from mapweave.session import shared_dir
from mapweave.sources.versions import VersionedTable
from mapweave.streaming.state import keep_state

_LOG = """SELECT event_id AS id, event_type, concat('user', CAST(user_id % 7 AS STRING)) AS entity_type, user_id AS entity_id, ts AS recorded_at FROM events"""


def _sql(t, text, *tables):
    for name in tables:
        getattr(t, name).createOrReplaceTempView(name)
    return t.spark.sql(text)


@query("g01_audit_append", f"SELECT id, event_type, entity_type, entity_id, recorded_at, CAST(recorded_at AS DATE) AS day FROM ({_LOG})")
def _(t):
    path = shared_dir(t.spark, "audit")
    log = _sql(t, _LOG, "events")
    A.write_audit(log.where("event_type = 'error'"), path)
    A.write_audit(log.where("event_type <> 'error'"), path)
    schema = "id bigint, event_type string, entity_type string, entity_id bigint, recorded_at timestamp_ntz, day date"
    return t.spark.read.schema(schema).parquet(path)


@query("g02_audit_query", f"""SELECT id, event_type, entity_id, recorded_at FROM ({_LOG}) WHERE event_type = 'purchase' AND entity_type = 'user3'
 ORDER BY recorded_at DESC, id LIMIT 100""")
def _(t):
    log = _sql(t, _LOG, "events")
    return A.query_audit(log, 100, event_type="purchase", entity_type="user3", entity_id=None).drop("entity_type")


@query("g03_lineage_append", f"""SELECT 'source_column' AS source_type, 'c' || l_partkey AS source_id, 'mapping_column' AS target_type, 'm' || l_orderkey AS target_id, 'feeds' AS edge_type
 FROM (SELECT l_orderkey, l_partkey FROM lineitem UNION ALL SELECT l_orderkey, l_suppkey FROM lineitem)
UNION ALL SELECT 'mapping_column', 'm' || l_orderkey, 'staging_column', l_returnflag || '.' || l_linestatus, 'produces' FROM lineitem""")
def _(t):
    columns = t.lineitem.select(
        F.concat(F.lit("m"), F.col("l_orderkey").cast("string")).alias("mapping_column_id"),
        F.col("l_returnflag").alias("target_table"), F.col("l_linestatus").alias("target_column"),
        F.array(*[F.struct(F.concat(F.lit("c"), F.col(c).cast("string")).alias("source_column_id"))
                  for c in ("l_partkey", "l_suppkey")]).alias("source_columns"))
    edges = A.lineage_edges(columns)
    path = shared_dir(t.spark, "lineage")
    A.write_lineage(edges, path)
    return t.spark.read.schema(edges.schema).parquet(path)


_EDGES = """SELECT 'orders' AS source_type, l_orderkey AS source_id, 'lineitem' AS target_type, l_partkey AS target_id, l_returnflag AS edge_type FROM lineitem"""


@query("g04_lineage_lookup", f"""SELECT *, 'upstream' AS direction FROM ({_EDGES}) WHERE target_id = 77
UNION ALL SELECT *, 'downstream' FROM ({_EDGES}) WHERE source_id = 77""")
def _(t):
    return A.lineage_of(_sql(t, _EDGES, "lineitem"), 77)


# Orders come from customers, these from nations, these from the next nation of their region (a cycle) and the region.
_HOPS = """SELECT 'order' AS source_type, o_orderkey AS source_id, 'customer' AS target_type, o_custkey AS target_id FROM orders
UNION ALL SELECT 'customer', c_custkey, 'nation', c_nationkey FROM customer
UNION ALL SELECT 'nation', n_nationkey, 'nation', coalesce(lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey),
 min(n_nationkey) OVER (PARTITION BY n_regionkey)) FROM nation
UNION ALL SELECT 'nation', n_nationkey, 'region', n_regionkey FROM nation WHERE n_nationkey % 5 < 2"""
# The longest way without a repeated node has 3 + 24 hops.
_REACHED = f"""WITH RECURSIVE e AS ({_HOPS}), r AS (SELECT *, 1 AS hops FROM e
 UNION SELECT r.source_type, r.source_id, e.target_type, e.target_id, hops + 1 FROM r JOIN e ON r.target_type = e.source_type AND r.target_id = e.source_id WHERE hops < 28),
c AS (SELECT source_type, source_id, target_type, target_id, min(hops) AS hops FROM r GROUP BY ALL)"""


@query("g04_lineage_closure", f"""{_REACHED} SELECT source_type, CAST(source_id AS VARCHAR) AS source_id, target_type, CAST(target_id AS VARCHAR) AS target_id, hops FROM c""")
def _(t):
    """All pairs of nodes with a way between them, through any number of hops."""
    edges = L.typed_edges(_sql(t, _HOPS, "orders", "customer", "nation"))
    return L.closure(edges).select(F.col("source.type").alias("source_type"), F.col("source.id").alias("source_id"),
                                   F.col("target.type").alias("target_type"), F.col("target.id").alias("target_id"), "hops")


@query("g04_lineage_trace", f"""{_REACHED} SELECT target_id AS region, source_type AS derived, hops, count(*) AS n FROM c WHERE target_type = 'region' GROUP BY ALL""")
def _(t):
    """How many nodes of each type come from each region, by hops."""
    edges = L.typed_edges(_sql(t, _HOPS, "orders", "customer", "nation"))
    regions = t.nation.select(F.struct(F.lit("region").alias("type"), F.col("n_regionkey").cast("string").alias("id")).alias("node")).distinct()
    return L.trace(edges, regions).groupBy(F.col("start.id").cast("long").alias("region"), F.col("node.type").alias("derived"), "hops").agg(F.count("*").alias("n"))


_DETAIL = "replace(substring(text, 1, 300), chr(10), ' ')"
_TRACE = f"""(SELECT o_custkey % 50 AS spec_id, o_orderkey AS mapping_column_id, 'source' AS kind, s AS ref, f AS raw_file_id, c_name AS original_filename, CAST(NULL AS VARCHAR) AS detail, CAST(NULL AS VARCHAR) AS content_sha256
 FROM (SELECT *, 'o_totalprice' AS s, 'f' || o_custkey AS f FROM orders UNION ALL SELECT *, o_orderpriority, 'g' || o_custkey FROM orders) LEFT JOIN customer ON f = 'f' || c_custkey
UNION ALL SELECT o_custkey % 50, o_orderkey, 'evidence', 'e' || doc_id, 'f' || (doc_id * 3), coalesce(c_name, 'unknown'), {_DETAIL}, sha256(text)
 FROM orders JOIN documents ON doc_id = o_custkey LEFT JOIN customer ON c_custkey = doc_id * 3
UNION ALL SELECT o_custkey % 50, o_orderkey, 'rule', 'r' || p_partkey, NULL, NULL, p_name, NULL FROM orders JOIN part ON p_partkey = o_custkey WHERE o_orderstatus = 'F')"""


def _trace(t):
    o = t.orders
    ref = lambda s, f: F.struct(s.alias("source_column"), F.concat(F.lit(f), F.col("o_custkey").cast("string")).alias("raw_file_id"))
    columns = o.select(
        (F.col("o_custkey") % 50).alias("spec_id"), F.col("o_orderkey").alias("mapping_column_id"),
        F.array(ref(F.lit("o_totalprice"), "f"), ref(F.col("o_orderpriority"), "g")).alias("source_columns"),
        F.array(F.concat(F.lit("e"), F.col("o_custkey").cast("string"))).alias("evidence_ids"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.concat(F.lit("r"), F.col("o_custkey").cast("string")))).alias("rule_ids"))
    files = t.customer.select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("raw_file_id"), F.col("c_name").alias("original_filename"))
    evidence = t.documents.select(F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("evidence_id"),
                                  F.concat(F.lit("f"), (F.col("doc_id") * 3).cast("string")).alias("raw_file_id"), F.col("text").alias("content"))
    rules = t.part.select(F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("rule_id"), F.col("p_name").alias("rule_text"))
    return A.provenance(columns, files, evidence, rules)


@query("g05_full_provenance", f"SELECT * FROM {_TRACE}")
def _(t):
    return _trace(t)


@query("g06_provenance_counts", f"""SELECT spec_id, count(DISTINCT mapping_column_id) AS mappings, count(DISTINCT ref) FILTER (WHERE kind = 'evidence') AS evidence_cited,
 count(DISTINCT ref) FILTER (WHERE kind = 'rule') AS rules_cited, count(DISTINCT raw_file_id) FILTER (WHERE original_filename IS NOT NULL) AS source_files,
 count(DISTINCT content_sha256) AS snippets FROM {_TRACE} GROUP BY 1""")
def _(t):
    return A.provenance_counts(_trace(t))


@query("g07_run_record", """SELECT event_id AS run_id, user_id AS spec_id, event_type AS status, ts AS started_at, ts + INTERVAL 5 MINUTE AS finished_at FROM events""")
def _(t):
    path = shared_dir(t.spark, "runs")
    runs = t.events.select(F.col("event_id").alias("run_id"), F.col("user_id").alias("spec_id"), F.col("event_type").alias("status"),
                           F.col("ts").alias("started_at"), F.expr("ts + INTERVAL 5 MINUTE").alias("finished_at"))
    A.write_runs(runs, path)
    return t.spark.read.schema(runs.schema).parquet(path).drop("day")


@query("g08_filtered_latest_list", """SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'
 ORDER BY o_orderdate DESC, o_orderkey LIMIT 75""")
def _(t):
    rows = A.list_latest(t.orders, {"o_orderstatus": "F", "o_orderpriority": "2-HIGH", "o_custkey": None}, "o_orderdate", "o_orderkey", 75)
    return rows.select("o_orderkey", "o_orderdate", "o_orderstatus")


@query("g09_current_state", """SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, arg_max(value, (ts, event_id)) AS value, max(ts) AS at FROM events GROUP BY 1""")
def _(t):
    changes = t.events.select("user_id", F.col("event_type").alias("status"), "value", F.col("ts").alias("at"), "event_id")
    return A.current_state(changes, "user_id", F.struct("at", "event_id")).drop("event_id")


@query("g09_state_kept_by_a_stream", """SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, arg_max(value, (ts, event_id)) AS value, max(ts) AS at FROM events GROUP BY 1""")
def _(t):
    """The current state again, from changes that arrive in shuffled micro-batches."""
    path = shared_dir(t.spark, "state")
    changes = t.events.select("user_id", F.col("event_type").alias("status"), "value", F.col("ts").alias("at"), "event_id")
    changes.repartition(4, F.crc32(F.col("event_id").cast("string"))).write.parquet(f"{path}/changes")
    table = VersionedTable.create(changes.where("false"), f"{path}/table", "user_id", 8)
    stream = t.spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/changes")
    query = keep_state(stream, table, ["at", "event_id"], f"{path}/checkpoint")
    query.awaitTermination()
    return table.read().drop("event_id")


@query("g10_versioned_changes", """SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN 'new ' || c_name ELSE c_name END AS c_name,
 CASE WHEN c_custkey % 4 = 1 THEN 1 ELSE 0 END AS version FROM customer WHERE c_custkey % 4 <> 2
UNION ALL SELECT -c_custkey, c_name, 2 FROM customer WHERE c_custkey % 4 = 3""")
def _(t):
    """Upsert, patch, delete and replace, each as one version."""
    stored = t.customer.select("c_custkey", "c_name", F.lit(0).alias("version"))
    table = VersionedTable.create(stored, shared_dir(t.spark, "versioned"), "c_custkey", 16)
    table.upsert(stored.where("c_custkey % 4 = 1").withColumn("version", F.lit(1)), ["version"])
    table.patch(stored.where("c_custkey % 4 = 1").select("c_custkey", F.array(F.lit("c_name")).alias("given"),
                                                         F.concat(F.lit("new "), "c_name").alias("c_name")), ["c_name"])
    table.delete(stored.where("c_custkey % 4 = 2"))
    table.replace(stored.where("c_custkey % 4 = 3").select((-F.col("c_custkey")).alias("c_custkey"), "c_name", F.lit(2).alias("version")))
    table.expire(keep=1)
    return table.read()


@query("g10_upsert", """SELECT coalesce(o.o_custkey, c_custkey) AS file_id, coalesce(o.label, c_mktsegment) AS profile, coalesce(o.v, 0) AS version FROM customer
 FULL JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS label, max(o_orderkey) AS v FROM orders GROUP BY 1) o ON c_custkey = o_custkey""")
def _(t):
    stored = t.customer.select(F.col("c_custkey").alias("file_id"), F.col("c_mktsegment").alias("profile"), F.lit(0).cast("bigint").alias("version"))
    fresh = t.orders.select(F.col("o_custkey").alias("file_id"), F.col("o_orderpriority").alias("profile"), F.col("o_orderkey").alias("version"))
    return A.upsert(stored, fresh, "file_id", "version")


@query("g10_partial_patch", """SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'new ' || c_name ELSE c_name END AS c_name,
 CASE WHEN c_nationkey % 3 = 1 THEN CASE WHEN c_acctbal > 0 THEN 'X' END ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def _(t):
    stored = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    given = (F.when(F.col("c_nationkey") % 3 == 0, F.array(F.lit("c_name")))
             .when(F.col("c_nationkey") % 3 == 1, F.array(F.lit("c_mktsegment"))))
    changes = t.customer.where("c_nationkey % 3 < 2").select(
        "c_custkey", given.alias("given"), F.concat(F.lit("new "), "c_name").alias("c_name"),
        F.when(F.col("c_acctbal") > 0, "X").alias("c_mktsegment"))
    return A.patch(stored, changes, "c_custkey", ["c_name", "c_mktsegment"])


@query("g11_result_pages", """SELECT 'third' AS which, o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 50)
UNION ALL SELECT 'last', o_orderkey, o_totalprice FROM (SELECT * FROM orders WHERE o_orderkey >= (SELECT CAST(floor((count(*) - 1) / 25) * 25 AS BIGINT) FROM orders) ORDER BY o_orderkey)""")
def _(t):
    orders = t.orders.select("o_orderkey", "o_totalprice")
    kept = A.Pages.write(orders, "o_orderkey", shared_dir(t.spark, "pages"))
    third, last = kept.page(3, 25)[0], kept.page(10**9, 25)[0]
    return third.withColumn("which", F.lit("third")).unionByName(last.withColumn("which", F.lit("last")))


@query("g11_pages_of_text_keys", """WITH k AS (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_name || c_custkey END AS k FROM customer),
r AS (SELECT *, row_number() OVER (ORDER BY k NULLS FIRST, c_custkey) - 1 AS place, count(*) OVER () AS n FROM k)
SELECT CASE WHEN place BETWEEN 100 AND 149 THEN 'nulls' ELSE 'middle' END AS which, count(*) AS n, count(k) AS present, min(k) AS first, max(k) AS last
FROM r WHERE place BETWEEN 100 AND 149 OR place // 50 = (n // 2) // 50 GROUP BY 1""")
def _(t):
    """Pages by a text key of which a third is null: one among the nulls, one in the middle."""
    keyed = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.concat("c_name", "c_custkey")).alias("k"))
    kept = A.Pages.write(keyed, "k", shared_dir(t.spark, "pages"))
    parts = [kept.page(number, 50)[0].withColumn("which", F.lit(which))
             for which, number in (("nulls", 3), ("middle", kept.total // 2 // 50 + 1))]
    return parts[0].union(parts[1]).groupBy("which").agg(
        F.count("*").alias("n"), F.count("k").alias("present"), F.min("k").alias("first"), F.max("k").alias("last"))


@query("g12_batch_detail", """SELECT c_custkey AS batch_id, c_name AS label, slice_no, any_value(n) AS n_items, string_agg(o_orderkey || ' ' || o_orderstatus, ', ' ORDER BY o_orderkey) AS files
 FROM (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS slice_no, count(*) OVER (PARTITION BY o_custkey) AS n
  FROM customer JOIN orders ON c_custkey = o_custkey) GROUP BY 1, 2, 3""")
def _(t):
    files = t.orders.select(F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("file_id"), F.col("o_orderstatus").alias("status"))
    nested = nest(files, ["batch_id"], "file_id", ["file_id", "status"], "files", slice_rows=4)
    text = F.array_join(F.transform("files", lambda f: F.concat_ws(" ", f["file_id"].cast("string"), f["status"])), ", ")
    batches = t.customer.select(F.col("c_custkey").alias("batch_id"), F.col("c_name").alias("label"))
    return batches.join(nested, "batch_id").select("batch_id", "label", "slice_no", "n_items", text.alias("files"))


@query("g13_active_rules", """SELECT o_orderkey AS spec_id, c_nationkey AS client_id, p_partkey AS rule_id, p_name AS rule_text FROM orders JOIN customer ON o_custkey = c_custkey
 JOIN part ON p_size = c_nationkey WHERE p_brand = 'Brand#7' AND o_orderstatus = 'P'""")
def _(t):
    specs = (t.orders.where("o_orderstatus = 'P'").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
             .select(F.col("o_orderkey").alias("spec_id"), F.col("c_nationkey").alias("client_id")))
    rules = t.part.select(F.col("p_size").alias("client_id"), F.col("p_partkey").alias("rule_id"), F.col("p_name").alias("rule_text"),
                          F.when(F.col("p_brand") == "Brand#7", "approved").otherwise("draft").alias("status"))
    return A.active_rules(rules, specs)


@query("g14_text_join", """SELECT spec_id, slice_no, any_value(n) AS n_items, string_agg(line, chr(10) ORDER BY line) AS text
 FROM (SELECT *, (row_number() OVER (PARTITION BY spec_id ORDER BY line) - 1) // 50 AS slice_no, count(*) OVER (PARTITION BY spec_id) AS n
  FROM (SELECT l_suppkey AS spec_id, '- ' || l_returnflag || ' ' || l_partkey AS line FROM lineitem)) GROUP BY 1, 2""")
def _(t):
    lines = t.lineitem.select(F.col("l_suppkey").alias("spec_id"), "l_returnflag", "l_partkey", "l_orderkey")
    text = F.concat_ws(" ", F.lit("-"), "l_returnflag", "l_partkey")
    return join_text(lines, ["spec_id"], "l_orderkey", text, "\n", "text", slice_rows=50)

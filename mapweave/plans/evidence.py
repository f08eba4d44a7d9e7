"""Evidence chunks and vector search (E1-E7) over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapweave.operators import evidence as E
from mapweave.operators.textindex import TextIndex
from mapweave.plans.registry import query


@query("e01_text_choice", """SELECT doc_id, sha256(CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN lang ELSE source END) AS text_sha FROM documents""")
def _(t):
    k = F.col("doc_id") % 3
    text = E.choose_text(F.when(k == 0, F.col("text")), F.when(k <= 1, F.col("lang")), F.col("source"))
    return t.documents.select("doc_id", F.sha2(text, 256).alias("text_sha"))


# Some documents get a long blank stretch; what follows it is kept.
_CHUNK_TEXT = "CASE WHEN doc_id % 5 = 0 THEN concat(substring(text, 1, 900), repeat(' ', 2500), text) WHEN doc_id % 97 = 1 THEN '   ' ELSE text END"


@query("e02_overlapping_chunks", f"""WITH d AS (SELECT doc_id, {_CHUNK_TEXT} AS text FROM documents),
c AS (SELECT doc_id, i, substring(text, CAST(i * 800 + 1 AS BIGINT), 1000) AS content FROM d, LATERAL (SELECT unnest(range(0, CAST(ceil(length(text) / 800.0) AS BIGINT))) AS i) r),
b AS (SELECT * FROM c WHERE regexp_matches(content, '[^\\s\\p{{Z}}]'))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, sha256(content) AS content_sha, CAST(length(content) AS BIGINT) AS n FROM b""")
def _(t):
    docs = t.documents.select("doc_id", F.expr(_CHUNK_TEXT).alias("text"))
    return E.chunks(docs).select("doc_id", "chunk_index", F.sha2("content", 256).alias("content_sha"),
                                 F.length("content").cast("bigint").alias("n"))


_DISTANCE = "round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 12)"


@query("e03_cosine_top_k", f"""SELECT a.vec_id, round({_DISTANCE}, 6) AS distance FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
 WHERE a.label <> 3 ORDER BY {_DISTANCE}, a.vec_id LIMIT 20""")
def _(t):
    vector = t.embeddings.where("vec_id = 0").head()["embedding"]
    hits = E.search(t.embeddings, vector, 20, F.col("label") != 3, "vec_id", "embedding")
    return hits.select(F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


# One query per label: its first vector.
_HITS = f"""(SELECT q.label AS query_id, a.vec_id AS id, {_DISTANCE} AS d, row_number() OVER (PARTITION BY q.label ORDER BY {_DISTANCE}, a.vec_id) AS rank
 FROM embeddings a, (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1) q)"""


def _hits(t, k):
    queries = t.embeddings.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("vector"))
    return E.nearest(t.embeddings, queries, k, "vec_id", "embedding")


@query("e04_batch_top_k", f"SELECT query_id, id AS vec_id, round(d, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM {_HITS} WHERE rank <= 7")
def _(t):
    return _hits(t, 7).select("query_id", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"), "rank")


@query("e05_evidence_gather", f"""SELECT id AS vec_id, query_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY query_id, rank) AS first
 FROM {_HITS} WHERE rank <= 5) WHERE first = 1""")
def _(t):
    return E.gather(_hits(t, E.HITS_PER_QUERY)).withColumnRenamed("id", "vec_id")


@query("e06_query_terms", """SELECT DISTINCT query FROM (
 SELECT unnest(['target table ' || p_brand, 'map ' || p_name, p_brand || ' ' || p_name]) AS query FROM part
 UNION ALL SELECT unnest(['Customer#' || s_suppkey % 50 || ' ' || s_name, 'column ' || s_name]) FROM supplier
 UNION ALL SELECT unnest(['region code mapping', 'revenue calculation', 'total revenue', 'line total', 'customer name misspelling', 'test orders exclude']))""")
def _(t):
    contract = t.part.select(F.col("p_brand").alias("target_table"), F.col("p_name").alias("target_column"))
    catalog = t.supplier.select(F.concat(F.lit("Customer#"), (F.col("s_suppkey") % 50).cast("string")).alias("display_name"),
                                F.col("s_name").alias("column_name"))
    return E.query_terms(contract, catalog)


_TERMS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\t\\n\\x0B\\f\\r ]+'), lambda w: w <> '')"


def _search_sql(asked: str, k: int) -> str:
    """TF-IDF cosine distances of all documents to each text that ``asked`` selects as (query, text)."""
    return f"""WITH t AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest({_TERMS}) AS w FROM documents) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents), f AS (SELECT w, ln((n + 1) / (count(*) + 1)) AS idf FROM t, n GROUP BY w, n),
v AS (SELECT doc_id, w, c * idf AS x FROM t JOIN f USING (w)), l AS (SELECT doc_id, sqrt(sum(x * x)) AS l FROM v GROUP BY 1),
a AS ({asked}), qt AS (SELECT query, w, count(*) AS c FROM (SELECT query, unnest({_TERMS}) AS w FROM a) GROUP BY ALL),
qv AS (SELECT query, w, c * coalesce(idf, ln(n + 1)) AS x FROM qt LEFT JOIN f USING (w), n), ql AS (SELECT query, sqrt(sum(x * x)) AS l FROM qv GROUP BY 1),
s AS (SELECT query, doc_id, sum(v.x * qv.x / l.l) AS s FROM v JOIN qv USING (w) JOIN l USING (doc_id) WHERE l.l > 0 GROUP BY ALL),
r AS (SELECT query, d.doc_id, round(1 - coalesce(s / l, 0), 12) AS distance FROM ql CROSS JOIN documents d LEFT JOIN s USING (query, doc_id))
SELECT query, doc_id, round(distance, 6) AS distance FROM r QUALIFY row_number() OVER (PARTITION BY query ORDER BY r.distance, doc_id) <= {k}"""


_ASKED = "SELECT 'item' AS query, arg_min(text, item_id) AS text FROM benchmark UNION ALL SELECT 'fixed', 'license the region revenue code'"


@query("e07_text_search", _search_sql(_ASKED, 10))
def _(t):
    index = TextIndex(t.documents, "doc_id", "text")
    asked = {"item": t.benchmark.orderBy("item_id").head()["text"], "fixed": "license the region revenue code"}
    hits = [index.search(text, 10).select(F.lit(name).alias("query"), F.col("id").alias("doc_id"), F.round("distance", 6).alias("distance"))
            for name, text in asked.items()]
    return hits[0].union(hits[1])

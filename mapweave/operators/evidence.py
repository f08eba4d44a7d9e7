"""Evidence: overlapping text chunks and nearest-vector search."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

CHUNK_SIZE, CHUNK_OVERLAP = 1000, 200
# Fixed value: hits per query.
HITS_PER_QUERY = 5
# Search texts that every mapping asks for.
COMMON_QUERIES = ("region code mapping", "revenue calculation", "total revenue", "line total",
                  "customer name misspelling", "test orders exclude")
# Queries of one tile; a tile of the corpus has 64 times as many rows.
QUERY_TILE = 1024
_DIGITS = 12


def choose_text(full_text: Column, text: Column, body_text: Column) -> Column:
    """Text of a parsed document, by kind of document."""
    return F.coalesce(full_text, text, body_text)


def chunks(documents: DataFrame, text: str = "text", size: int = CHUNK_SIZE,
           overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Overlapping chunks (chunk_index, content) of each document's whole text.

    A chunk starts every ``size - overlap`` characters; blank chunks are left out
    and not counted. The text is cut once into steps and each chunk is a step plus
    the start of what follows, so the work is linear in the text and stays
    within the row.
    """
    step = size - overlap
    following = -(-overlap // step)
    steps = F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{step}}})"), F.lit(1))
    chunk = F.transform("_steps", lambda s, i: F.substring(F.array_join(F.slice("_steps", i + 1, 1 + following), ""), 1, size))
    kept = F.filter("_chunks", lambda c: c.rlike(r"(?U)[^\s\x1c-\x1f]"))
    rest = [c for c in documents.columns if c != text]
    return (documents.withColumn("_steps", steps).withColumn("_chunks", chunk)
            .select(*rest, F.posexplode(kept).alias("chunk_index", "content")))


def _best(ids: np.ndarray, distances: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest, nearest first, then by id; unknown distances last."""
    far = np.where(np.isnan(distances), np.inf, distances)
    if len(far) > k:
        near = np.flatnonzero(far <= np.partition(far, k - 1)[k - 1])
    else:
        near = np.arange(len(far))
    return near[np.lexsort((ids[near], far[near]))][:k]


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.full_like(matrix, np.nan), where=norms > 0)


def _matrix(vectors, dim: int) -> np.ndarray:
    """Rows as a matrix; a missing or ill-sized vector becomes a zero row."""
    if isinstance(vectors, pa.ListArray) and vectors.null_count == 0 and len(vectors.flatten()) == dim * len(vectors):
        flat = vectors.flatten()
        if flat.null_count == 0 and np.all(np.diff(vectors.offsets.to_numpy()) == dim):
            return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), dim)
    rows = vectors.to_pylist() if isinstance(vectors, pa.Array) else list(vectors)
    return np.array([r if r is not None and len(r) == dim else [0.0] * dim for r in rows], dtype=np.float64).reshape(len(rows), dim)


def _nearest_in(batches, queries: np.ndarray, k: int):
    """Running k best (ids, distances) per query over (ids, vectors) batches."""
    best: list[tuple[np.ndarray, np.ndarray]] | None = None
    for ids, vectors in batches:
        if not len(ids):
            continue
        distances = np.round(1.0 - _unit(_matrix(vectors, queries.shape[1])) @ queries.T, _DIGITS)
        found = []
        for q in range(queries.shape[0]):
            all_ids, all_d = ids, distances[:, q]
            if best is not None:
                all_ids, all_d = np.concatenate([best[q][0], ids]), np.concatenate([best[q][1], all_d])
            top = _best(all_ids, all_d, k)
            found.append((all_ids[top], all_d[top]))
        best = found
    return best or []


def nearest(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "vector",
            tile: int = QUERY_TILE) -> DataFrame:
    """k nearest corpus vectors of each query by cosine distance (exact).

    ``queries``: query_id, vector. Result: query_id, id, distance, rank; ties
    go to the smaller id. Unknown distances come last: those of null, empty and
    zero vectors, and between vectors of different width. Tiles of both sides,
    cut by a hash of the id, meet once; a tile holds about ``tile`` queries and
    64 times as many corpus rows. k rows per query and tile are shuffled, never
    a pair of each. The tiles are laid out from the row counts of both sides.
    """
    corpus = corpus.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    schema = f"query_id {dict(queries.dtypes)['query_id']}, id {dict(corpus.dtypes)['id']}, distance double"
    partial = _tiled(corpus, queries.select("query_id", "vector"), k, schema, tile)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "id"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k)


def _tiled(corpus: DataFrame, queries: DataFrame, k: int, schema: str, tile: int) -> DataFrame:
    q_tiles = max(1, -(-queries.count() // tile))
    c_tiles = max(1, -(-corpus.count() // (64 * tile)))
    # Dealt by id and vector, so that many rows of one id are spread; any tile of a row is right.
    q = queries.withColumn("_q", F.pmod(F.xxhash64("query_id", "vector"), F.lit(q_tiles)).cast("int")).withColumn(
        "_c", F.explode(F.sequence(F.lit(0), F.lit(c_tiles - 1))))
    c = corpus.withColumn("_c", F.pmod(F.xxhash64("id", "vector"), F.lit(c_tiles)).cast("int")).withColumn(
        "_q", F.explode(F.sequence(F.lit(0), F.lit(q_tiles - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        query_type, id_type = right.schema.field("query_id").type, left.schema.field("id").type
        names, best = [], []
        if left.num_rows and right.num_rows:
            vectors = right.column("vector").to_pylist()
            asked = right.column("query_id").to_pylist()
            ids = left.column("id").combine_chunks().to_numpy(zero_copy_only=False)
            stored = left.column("vector").combine_chunks()
            # Queries of one width at a time; a null one has no width and no known distance.
            width = [len(v) if v else 0 for v in vectors]
            for w in sorted(set(width)):
                mine = [i for i, n in enumerate(width) if n == w]
                names += [asked[i] for i in mine]
                best += _nearest_in([(ids, stored)], _unit(_matrix([vectors[i] for i in mine], max(w, 1))), k)
        return pa.table({
            "query_id": pa.array([n for n, (ids, _) in zip(names, best) for _ in ids], query_type),
            "id": pa.array([i for ids, _ in best for i in ids], id_type),
            "distance": pa.array([None if np.isnan(d) else d for _, ds in best for d in ds], pa.float64())})

    return c.groupBy("_c", "_q").cogroup(q.groupBy("_c", "_q")).applyInArrow(meet, schema)


def search(corpus: DataFrame, vector: Sequence[float], k: int = HITS_PER_QUERY, condition: Column | None = None,
           id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """k nearest vectors (id, distance, rank) of one query, optionally within one client's rows.

    The query is a literal and the distance a built-in expression, so this is one
    scan with an ordered limit. Unknown distances come last, as in ``nearest``.
    """
    rows = corpus if condition is None else corpus.where(condition)
    stored = F.col(vector_col).cast("array<double>")
    asked = F.array(*[F.lit(float(x)) for x in vector]).cast("array<double>")

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    norms = F.sqrt(total(F.transform(stored, lambda x: x * x))) * float(np.linalg.norm(np.asarray(vector, float)))
    product = total(F.zip_with(stored, asked, lambda a, b: a * b))
    distance = F.when((F.size(stored) == len(vector)) & (norms > 0), F.round(1 - product / norms, _DIGITS))
    best = rows.select(F.col(id_col).alias("id"), distance.alias("distance")).orderBy(
        F.col("distance").asc_nulls_last(), "id").limit(k)
    # At most k rows are numbered.
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.col("distance").asc_nulls_last(), "id")))


def gather(hits: DataFrame, max_total: int | None = None) -> DataFrame:
    """Union of the hits of ordered queries: each id once where first seen.

    ``hits``: query_id (its order), id, rank. ``max_total`` keeps the first ones,
    in order; without it the union is complete and unordered.
    """
    first = hits.groupBy("id").agg(F.min(F.struct("query_id", "rank")).alias("_seen"))
    seen = first.select("id", "_seen.query_id", "_seen.rank")
    return seen if max_total is None else seen.orderBy("query_id", "rank").limit(max_total)


def query_terms(contract: DataFrame, catalog: DataFrame) -> DataFrame:
    """Distinct search texts for a contract and a source catalog.

    ``contract``: target_table, target_column. ``catalog``: display_name,
    column_name.
    """
    def texts(df: DataFrame, *columns: Column) -> DataFrame:
        return df.select(F.explode(F.array(*columns)).alias("query"))

    table, column = F.col("target_table"), F.col("target_column")
    target = texts(contract, F.concat(F.lit("target table "), table), F.concat(F.lit("map "), column),
                   F.concat_ws(" ", table, column))
    named = catalog.where(F.nullif("column_name", F.lit("")).isNotNull())
    source = texts(named, F.concat_ws(" ", F.coalesce("display_name", F.lit("")), F.col("column_name")),
                   F.concat(F.lit("column "), "column_name"))
    fixed = contract.sparkSession.createDataFrame([(q,) for q in COMMON_QUERIES], "query string")
    return target.unionByName(source).unionByName(fixed).distinct()

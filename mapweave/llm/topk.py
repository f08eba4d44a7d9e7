"""Exact top-k by inner product with a bit-sliced index.

Vectors are quantised to integers. A block of rows keeps, for each attribute,
one bitmap per binary digit. For a query the bitmaps of all attributes are added
up with bitmap arithmetic (a column of equal weight is reduced by full adders),
negative query digits taking complemented bitmaps, so that the score of all rows
stands in slices from the most to the least significant. Rows are then selected
from the top slice downward; rows that tie at the boundary are resolved by exact
scores and by the smaller id.

Rows that agree in id and vector are merged first and repeated in the result.
Candidates and queries are then cut into blocks by hash, of up to 65,536 rows
each; the work of a query hardly grows with a block, so only queries are cut
finer, into as many blocks as there are cores. Each pair of blocks is one task, which builds the index of its candidates
once and returns k rows per query; these are merged per query. Rows with a
component whose score might not fit 64 bits by way of the bitmaps are compared
by exact integers instead.

Defined cases: vectors that are null, empty or hold a null or non-finite
component take no part, nor do rows without an id; vectors of different length
are compared as if padded with zeros; repeated rows of an id are all candidates
of other queries; a repeated query id has one list, the best of all its vectors
together; scores are ranked exactly, and one beyond 64 bits is shown as the
greatest or least long; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP = 20
SCALE = 64
#: Rows of one candidate block and of one query block at most.
BLOCK_ROWS = 65_536
#: Queries that are worth a block of their own while there are idle cores.
LEAST_QUERIES = 1024
#: Components below this, in vectors of at most as many attributes as fit, cannot overflow a score of 64 bits.
SMALL, SMALL_WIDTH = 1 << 26, 1 << 10

Bitmaps = list  # of packed uint64 arrays


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, v, large): floor(scale * component) of the finite vectors; large ones are doubles in ``large``."""
    x = F.col(vector_column).cast("array<double>")
    fits = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    large = F.exists(x, lambda e: F.abs(e) >= SMALL / scale) | (F.size(x) > SMALL_WIDTH)
    small = F.transform(x, lambda e: F.floor(e * F.lit(float(scale))).cast("int"))
    # A double from 2**53 on has no fraction, so nothing is lost where floor would leave the longs.
    whole = F.transform(x, lambda e: F.when(F.abs(e) < float(1 << 53), F.floor(e * F.lit(float(scale))).cast("double")).otherwise(e * float(scale)))
    return vectors.filter(F.col(id_column).isNotNull() & (F.size(x) > 0) & fits).select(
        F.col(id_column).cast("long").alias("vec_id"), F.when(~large, small).alias("v"), F.when(large, whole).alias("large"))


class SlicedBlock:
    """Bitmaps of the digits of each attribute over the rows of a block."""

    def __init__(self, rows: np.ndarray) -> None:
        self.n, self.dims = rows.shape
        low = int(rows.min(initial=0))
        self.low = low
        shifted = rows - low
        self.digits = int(shifted.max(initial=0)).bit_length()
        pad = -self.n % 64
        bits = np.zeros((self.dims, self.digits, self.n + pad), np.uint8)
        for d in range(self.digits):
            bits[:, d, :self.n] = (shifted.T >> d) & 1
        self.slices = np.packbits(bits, axis=2, bitorder="little").view(np.uint64)
        self.rows = rows
        live = np.zeros(self.n + pad, np.uint8)
        live[:self.n] = 1
        self.live = np.packbits(live, bitorder="little").view(np.uint64)

    def score_slices(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of score + constant, least significant first.

        With u = v - low and M = 2**digits - 1, each q * u of a negative q is
        |q| * (M - u) - |q| * M, and M - u has the complemented bitmaps.
        """
        columns: list[list[np.ndarray]] = [[] for _ in range(80)]
        for d in np.flatnonzero(query).tolist():
            size, flip = abs(int(query[d])), query[d] < 0
            slices = [~s for s in self.slices[d]] if flip else list(self.slices[d])
            for bit in range(size.bit_length()):
                if size >> bit & 1:
                    for digit, s in enumerate(slices):
                        columns[bit + digit].append(s)
        out = []
        for weight in range(len(columns)):
            column = columns[weight]
            while len(column) > 2:
                a, b, c = column.pop(), column.pop(), column.pop()
                half = a ^ b
                column.insert(0, half ^ c)
                columns[weight + 1].append((a & b) | (c & half))
            if len(column) == 2:
                a, b = column
                columns[weight + 1].append(a & b)
                column = [a ^ b]
            out.append(column[0] if column else None)
        while out and out[-1] is None:
            out.pop()
        return out

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        """Indexes of the k best rows and of all that tie with the last of them."""
        sure = np.zeros_like(self.live)
        open_ = self.live.copy()
        for s in reversed(self.score_slices(query)):
            more = open_ & s if s is not None else np.zeros_like(open_)
            n = int(np.bitwise_count(sure | more).sum())
            if n > k:
                open_ = more
            else:
                sure |= more
                open_ &= ~more
                if n == k:
                    open_[:] = 0
                    break
        rows = np.unpackbits((sure | open_).view(np.uint8), bitorder="little")[:self.n]
        return np.flatnonzero(rows)

    def best(self, query: np.ndarray, own: int, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Indexes and scores of the k best rows, other than those of the query's own id."""
        own_rows = int((ids == own).sum())
        at = self.candidates(query, k + own_rows)
        at = at[ids[at] != own]
        score = self.rows[at] @ query
        order = np.lexsort((ids[at], -score))[:k]
        return at[order], score[order]


def _padded(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _integers(rows: pd.DataFrame) -> list[list[int]]:
    """Exact components of rows, small or large."""
    return [[int(e) for e in (v if large is None else large)] for v, large in zip(rows.v, rows.large)]


Pairs = list  # of (query id, index of the row, score)


def _exact_pairs(rows: pd.DataFrame, asked: pd.DataFrame, k: int) -> Pairs:
    """The k best rows of each query that have another id, by integers of any size."""
    if not len(rows) or not len(asked):
        return []
    out, vectors, ids, places = [], _integers(rows), rows.vec_id.tolist(), rows.index.tolist()
    for own, query in zip(asked.vec_id.tolist(), _integers(asked)):
        scored = [(-sum(a * b for a, b in zip(query, v)), i, at) for i, v, at in zip(ids, vectors, places) if i != own]
        out += [(own, at, -score) for score, _, at in sorted(scored)[:k]]
    return out


def _sliced_pairs(rows: pd.DataFrame, asked: pd.DataFrame, k: int) -> Pairs:
    """The same by the bit-sliced index, for small vectors."""
    if not len(rows) or not len(asked):
        return []
    width = max(rows.v.map(len).max(), asked.v.map(len).max())
    index, ids, places, out = SlicedBlock(_padded(rows.v, width)), rows.vec_id.to_numpy(), rows.index.to_numpy(), []
    for own, query in zip(asked.vec_id.tolist(), _padded(asked.v, width)):
        found, score = index.best(query, own, ids, k)
        out += zip([own] * len(found), places[found].tolist(), score.tolist())
    return out


def _beyond(score: int) -> str | None:
    """Nothing for a score of 64 bits; for others a text in the order of the numbers of one sign."""
    if -(1 << 63) <= score < 1 << 63:
        return None
    digits = str(abs(score))
    if score > 0:
        return f"{len(digits):05}{digits}"
    return f"{99999 - len(digits):05}" + "".join(str(9 - int(d)) for d in digits)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = TOP,
          blocks: tuple[int, int] | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of `quantised` queries against candidates.

    ``blocks``: of candidates and of queries; by default from their row counts.
    """
    queries = queries.distinct()
    merged = candidates.groupBy("vec_id", "v", "large").agg(F.count("*").alias("n"))
    if blocks is None:
        cores, n = candidates.sparkSession.sparkContext.defaultParallelism, queries.count()
        blocks = (max(-(-candidates.count() // BLOCK_ROWS), 1),
                  max(-(-n // BLOCK_ROWS), min(cores, -(-n // LEAST_QUERIES)), 1))
    block = lambda n: F.pmod(F.xxhash64("vec_id", "v", "large"), F.lit(n)).cast("int")
    left = merged.select("vec_id", "v", "large", "n", block(blocks[0]).alias("c"),
                         F.explode(F.sequence(F.lit(0), F.lit(blocks[1] - 1))).alias("q"))
    right = queries.select("vec_id", "v", "large", block(blocks[1]).alias("q"),
                           F.explode(F.sequence(F.lit(0), F.lit(blocks[0] - 1))).alias("c"))

    def search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        small, plain = rows.large.isna(), asked.large.isna()
        found = (_sliced_pairs(rows[small], asked[plain], k) + _exact_pairs(rows[~small], asked[plain], k)
                 + _exact_pairs(rows, asked[~plain], k))
        query, place, score = (list(x) for x in zip(*found)) if found else ([], [], [])
        low, high = -(1 << 63), (1 << 63) - 1
        return pd.DataFrame({
            "query_id": np.array(query, np.int64), "vec_id": rows.vec_id.loc[place].to_numpy(np.int64),
            "score": np.array([min(max(s, low), high) for s in score], np.int64),
            "beyond": pd.Series([_beyond(s) for s in score], dtype=object),
            "n": np.minimum(rows.n.loc[place].to_numpy(np.int64), k)})

    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInPandas(
        search, "query_id long, vec_id long, score long, beyond string, n long")
    # More than k repeats of a row change nothing.
    listed = found.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("_i", "n")
    far = F.when(F.col("beyond").isNull(), 0).otherwise(F.signum("score").cast("int"))
    best = Window.partitionBy("query_id").orderBy(F.desc(far), F.desc("beyond"), F.desc("score"), "vec_id")
    return listed.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")

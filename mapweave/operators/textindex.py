"""Inverted index over exact terms, with block maxima and an exact, pruned top-k search."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType
from pyspark.sql.window import Window as W

from mapweave.operators.heavy import HOT_KEYS
from mapweave.sources.tables import stage

#: Postings of a block, about; weights of a block differ by less than one level.
BLOCK_POSTINGS, LEVELS = 1024, 64
_BLOCK = ["term_id", "level", "part"]
#: Texts that are counted at a time.
_TEXTS = 256
_SPACE = r"[\t\n\x0B\f\r ]+"
_DIGITS = 12
#: More than what rounding and the order of sums can move a similarity by.
_SLACK = 1e-9


def terms(text: Column) -> Column:
    """Lower-cased words between ASCII white space; null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPACE), lambda w: w != "")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, term, n) from (id, lower-cased text in bytes); bytes are split at ASCII white space."""
    for batch in batches:
        for at in range(0, batch.num_rows, _TEXTS):
            part = batch.slice(at, _TEXTS)
            found = [Counter(text.split()) for text in part.column(1).to_pylist()]
            rows = np.repeat(np.arange(len(found)), [len(c) for c in found])
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(rows, pa.int64())), pa.array(list(chain.from_iterable(found)), pa.binary()),
                 pa.array(list(chain.from_iterable(c.values() for c in found)), pa.int64())], names=["id", "term", "n"])


def _counts(rows: DataFrame, unique: bool) -> DataFrame:
    """(id, term, n) of texts; rows of one id are added up unless ids are ``unique``."""
    lowered = rows.select("id", F.lower(F.coalesce("text", F.lit(""))).cast("binary").alias("text"))
    schema = StructType([rows.schema["id"], StructField("term", BinaryType()), StructField("n", LongType())])
    found = lowered.mapInArrow(_count, schema).withColumn("term", F.col("term").cast("string"))
    return found if unique else found.groupBy("id", "term").agg(F.sum("n").alias("n"))


def _weight(count: Column, n: int, df: Column) -> Column:
    return count * F.log((F.lit(float(n)) + 1) / (df + 1))


class TextIndex:
    """TF-IDF postings of texts: term by term, in blocks of like weight with their maximum.

    A posting's weight is divided by the length of its text's vector, so a score
    is a sum of products. Terms are numbered, and postings travel by number: those
    of the most frequent terms, of more than ``hot_rows`` texts and at most
    `HOT_KEYS` of them, meet their number where they lie, others by their term.
    A term is cut into blocks by weight and a hash of the id, so no task holds
    one. Rows that share an id are one text. The index is written below the
    shared folder, each file in order of the terms' numbers; the maxima of a
    block are taken when its term is asked for.
    """

    def __init__(self, corpus: DataFrame, id_col: str, text_col: str, block: int = BLOCK_POSTINGS,
                 hot_rows: int = 0) -> None:
        rows = corpus.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        self.ids = stage(rows.select("id").distinct(), "index-ids")
        self.n = self.ids.count()
        counts = stage(_counts(rows, rows.count() == self.n), "index-counts")
        known = counts.groupBy("term").agg(F.count("*").alias("df")).sortWithinPartitions("term")
        self.terms = stage(known.withColumn("term_id", F.monotonically_increasing_id()), "index-terms")
        most = self.terms.select("df").orderBy(F.desc("df")).limit(HOT_KEYS + 1).agg(F.count("*"), F.min("df")).head()
        least = max(hot_rows, most[1] if most[0] > HOT_KEYS else 0)
        few, others = F.broadcast(self.terms.where(F.col("df") > least)), self.terms.where(F.col("df") <= least)
        rest = counts.join(few.select("term"), "term", "left_anti").join(others.hint("shuffle_hash"), "term")
        numbered = counts.join(few, "term").unionByName(rest).select("id", "term_id", "df", "n").repartition("id")
        weighted = numbered.withColumn("w", _weight(F.col("n"), self.n, F.col("df")))
        length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id")))
        unit = weighted.withColumn("v", F.col("w") / F.nullif(length, F.lit(0.0))).where("v > 0")
        part = F.pmod(F.xxhash64("id"), F.ceil(F.col("df") / block)).cast("int")
        placed = unit.select("term_id", part.alias("part"), "id", "v")
        self.postings = stage(placed.repartition("term_id", "part").sortWithinPartitions("term_id"), "index-postings")
        self._asked: dict[tuple[int, ...], DataFrame] = {}

    def _picked(self, numbers: list[int]) -> DataFrame:
        """(term_id, level, part, id, v): the postings of terms, with the block of each; written once, since a search reads them often."""
        key = tuple(sorted(numbers))
        if key not in self._asked:
            level = F.floor(F.col("v") * LEVELS)
            found = self.postings.where(F.col("term_id").isin(numbers)).select("term_id", level.alias("level"), "part", "id", "v")
            self._asked[key] = stage(found, "index-asked")
        return self._asked[key]

    def query(self, text: str) -> list[tuple[int, float, float]] | None:
        """(term_id, weight, greatest weight in the corpus) of the terms of a query that texts hold; None without any weight."""
        session = self.ids.sparkSession
        asked = session.createDataFrame([(text,)], "text string").select(F.explode(terms(F.col("text"))).alias("term"))
        counted = [(r.term, r["count"]) for r in asked.groupBy("term").count().collect()]
        held = {r.term: r for r in self.terms.where(F.col("term").isin([t for t, _ in counted])).collect()}
        picked = self._picked([r.term_id for r in held.values()])
        tops = {r.term_id: r.top for r in picked.groupBy("term_id").agg(F.max("v").alias("top")).collect()}
        weights = {t: c * math.log((self.n + 1) / ((held[t].df if t in held else 0) + 1)) for t, c in counted}
        length = math.sqrt(math.fsum(w * w for w in weights.values()))
        return [(held[t].term_id, w / length, tops[held[t].term_id]) for t, w in sorted(weights.items())
                if w > 0 and t in held] if length else None

    def _blocks(self, query: list[tuple[int, float, float]]) -> DataFrame:
        """Blocks of the query's terms with the weight ``q`` of the term and ``bound``, the most that a text in one can score."""
        weight = F.create_map(*[F.lit(x) for t, q, _ in query for x in (t, q)])[F.col("term_id")]
        others = math.fsum(q * top for _, q, top in query)
        top = F.create_map(*[F.lit(x) for t, q, best in query for x in (t, q * best)])[F.col("term_id")]
        picked = self._picked([t for t, _, _ in query]).groupBy(*_BLOCK).agg(F.max("v").alias("top"))
        return picked.select(*_BLOCK, "top", weight.alias("q"), (weight * F.col("top") + F.lit(others) - top).alias("bound"))

    def _inside(self, query: list[tuple[int, float, float]], blocks: DataFrame) -> DataFrame:
        """(q, id, v): the postings of blocks."""
        return self._picked([t for t, _, _ in query]).join(blocks.select(*_BLOCK, "q"), _BLOCK).select("q", "id", "v")

    def threshold(self, query: list[tuple[int, float, float]], k: int) -> float:
        """A score that at least k texts reach: the k-th best over the blocks of greatest weight alone."""
        blocks = self._blocks(query).orderBy(F.desc(F.col("q") * F.col("top"))).limit(len(query) + k)
        scores = self._inside(query, blocks).groupBy("id").agg(F.sum(F.col("q") * F.col("v")).alias("score"))
        best = scores.orderBy(F.desc("score")).limit(k).agg(F.min("score"), F.count("*")).head()
        return best[0] if best[1] == k else 0.0

    def leading(self, query: list[tuple[int, float, float]], k: int) -> tuple[DataFrame, DataFrame]:
        """Blocks that name the texts which may be among the k best, and blocks that only add to their scores.

        Terms whose greatest products do not reach the threshold together name no
        text; of the others, blocks whose bound does not reach it are left out.
        """
        least = self.threshold(query, k) - _SLACK
        names, total = [], 0.0
        for term, q, top in sorted(query, key=lambda x: x[1] * x[2]):
            total += q * top
            if total >= least:
                names.append(term)
        blocks = self._blocks(query).where(F.col("bound") >= least)
        return blocks.where(F.col("term_id").isin(names)), blocks.where(~F.col("term_id").isin(names))

    def _best_scores(self, query: list[tuple[int, float, float]], k: int) -> DataFrame:
        """Scores that are exact for all texts which reach the threshold, and too small for others at most."""
        leading, adding = (self._inside(query, blocks) for blocks in self.leading(query, k))
        added = adding.join(leading.select("id").distinct(), "id", "left_semi")
        return leading.unionByName(added).groupBy("id").agg(F.sum(F.col("q") * F.col("v")).alias("score"))

    def search(self, text: str, k: int) -> DataFrame:
        """(id, distance) of the k texts nearest by cosine distance, ties by id; exact.

        A text in a block that was left out scores below the threshold in all, so
        what is missing of its sum does not matter. Texts without a term of
        the query follow at distance 1 where fewer than k have one; a query
        without a weight has no distances.
        """
        query = self.query(text)
        if not query:
            distance = F.lit(None if query is None else 1.0).cast("double")
            return self.ids.select("id", distance.alias("distance")).orderBy("id").limit(k)
        scores = self._best_scores(query, k)
        found = scores.select("id", F.round(1 - F.col("score"), _DIGITS).alias("distance")).orderBy("distance", "id").limit(k)
        others = self.ids.join(scores, "id", "left_anti").orderBy("id").limit(k).select("id", F.lit(1.0).alias("distance"))
        return found.union(others).orderBy("distance", "id").limit(k)

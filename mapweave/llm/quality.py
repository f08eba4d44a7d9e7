"""Quality by ordinal cumulative-link regression on graded ratings.

All grades share one weight vector over hashed text features; ordered thresholds
cut its scale: P(grade <= k) = logistic(threshold_k - w.x). The result is the
expected grade and the probability of reaching a grade, which selects.

Defined cases: null text is like an empty one, whose features are zero; without
labelled rows, or with one grade only, nothing can be told apart: grade and
probability are null and every document is kept; repeated rows stay repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapweave.llm.common import binary_texts, pieces, ship, unpack
from mapweave.llm.features import DIMS, SAMPLE_ROWS, feature_rows, hashed, labelled_sample

#: A document is kept if it reaches `KEEP_GRADE` with at least this probability.
KEEP_GRADE, KEEP_PROBABILITY = 1, 0.5
_SCALE = 10.0


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., one column each."""
        return _logistic(x @ (self.weights * _SCALE) - self.thresholds[:, None]).T


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_ordinal(x: np.ndarray, grades: np.ndarray, n_grades: int, ridge: float = 1e-4, rounds: int = 300,
                rate: float = 0.05) -> OrdinalModel:
    """Maximum likelihood by Adam steps over the whole sample.

    Thresholds are a first value and positive gaps, so they stay in order.
    """
    x = x * np.float32(_SCALE)
    w = np.zeros(x.shape[1])
    share = np.clip(np.array([(grades >= k).mean() for k in range(1, n_grades)]), 0.01, 0.99)
    cuts = np.maximum.accumulate(-np.log(share / (1 - share)))
    theta = np.concatenate((cuts[:1], np.log(np.maximum(np.diff(cuts), 0.1))))
    params = np.concatenate((w, theta))
    m, v = np.zeros_like(params), np.zeros_like(params)
    n, d = len(x), len(w)
    for t in range(1, rounds + 1):
        gaps = np.exp(params[d + 1:])
        cuts = params[d] + np.concatenate(([0.0], np.cumsum(gaps)))
        edges = np.concatenate(([-np.inf], cuts, [np.inf]))
        score = x @ params[:d].astype(np.float32)
        with np.errstate(over="ignore"):
            up = 1 / (1 + np.exp(-(edges[grades + 1] - score)))
            low = 1 / (1 + np.exp(-(edges[grades] - score)))
        p = np.maximum(up - low, 1e-12)
        du, dl = up * (1 - up) / p, low * (1 - low) / p
        g_score = du - dl
        g_edge = np.zeros(len(cuts))
        np.add.at(g_edge, np.minimum(grades, len(cuts) - 1), np.where(grades < len(cuts), -du, 0))
        np.add.at(g_edge, np.maximum(grades - 1, 0), np.where(grades > 0, dl, 0))
        after = np.cumsum(g_edge[::-1])[::-1]
        g = np.concatenate(((x.T @ g_score.astype(np.float32)) / n + ridge * params[:d], [after[0] / n],
                            after[1:] * gaps / n))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    cuts = params[d] + np.concatenate(([0.0], np.cumsum(np.exp(params[d + 1:]))))
    return OrdinalModel(params[:d].astype(np.float32), cuts.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, grade, rows: int = SAMPLE_ROWS, dims: int = DIMS) -> OrdinalModel | None:
    """Fit on at most ``rows`` labelled documents; ``grade`` is a column 0, 1, ... of labels."""
    x, y = feature_rows(labelled_sample(docs, labels, grade.cast("int"), rows), rows, dims)
    if len(y) == 0 or y.min() == y.max():
        return None
    return fit_ordinal(x, y, int(y.max()) + 1)


def rated_quality():
    """Grades of the label table: 0 bad, 1 good but toxic, 2 good."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0))
    return F.when(F.col("quality") == 0, 0).when(F.col("quality") > 0, F.when(toxic > 0, 1).otherwise(2))


def grade_documents(docs: DataFrame, model: OrdinalModel | None, keep_grade: int = KEEP_GRADE) -> DataFrame:
    """The documents with ``_llm_expected_grade`` and ``_llm_tail_probability``."""
    names = docs.columns
    at = names.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("_llm_expected_grade", T.DoubleType()),
                           T.StructField("_llm_tail_probability", T.DoubleType())])
    shipped = ship(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = unpack(shipped)
        for batch in pieces(batches):
            if fitted is None:
                grade = tail = pa.nulls(batch.num_rows, pa.float64())
            else:
                texts = binary_texts(batch.column(at))
                tails = np.concatenate([np.zeros((0, len(fitted.thresholds)))] + [
                    fitted.tails(hashed(texts[s:s + 1000], len(fitted.weights))) for s in range(0, len(texts), 1000)])
                grade = pa.array(tails.sum(axis=1).astype(np.float64))
                tail = pa.array(tails[:, min(keep_grade, tails.shape[1]) - 1].astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, grade, tail], names=schema.names)

    return docs.mapInArrow(run, schema)


def kept() -> Column:
    return F.coalesce(F.col("_llm_tail_probability") >= KEEP_PROBABILITY, F.lit(True))


def grades(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, kept) of every document."""
    graded = grade_documents(docs.select("doc_id", "text"), train(docs, labels, rated_quality()))
    return graded.select("doc_id", F.col("_llm_expected_grade").alias("expected_grade"),
                         F.col("_llm_tail_probability").alias("tail_probability"), kept().alias("kept"))


def select_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, unchanged."""
    graded = grade_documents(docs, train(docs, labels, rated_quality()))
    return graded.filter(kept()).select(*[f"`{n}`" for n in docs.columns])

"""Mixing sources to target weights with soft domain membership.

A softmax classifier over hashed text features, fitted on a bounded sample of
the labelled table, gives each document a posterior over the domains. Documents
then get nonnegative rates r (expected copies) such that the expected tokens of
each domain, the sum of r * tokens * posterior, meet the target shares of all
tokens. The rates minimise the squared miss of the shares plus a small penalty
on leaving rate 1, by projected gradient steps with momentum. Misses are scaled
by the inverse of the domains' second moments, so that a rare domain moves as
fast as a common one, and the penalty falls with the steps. Steps end when each
share is within TOLERANCE of its target; if ROUNDS steps or STALLED steps without
progress come first, a warning gives the misses. A step needs the current domain
totals only: a sum over the documents in Spark, one short row per step. Rates are a function of posterior and past totals, so each step recomputes
them from a staged table of posteriors and nothing is held in executors.

Defined cases: null and empty texts have no tokens, so they weigh nothing, and a
posterior equal to the class shares the classifier falls back on; without
labelled rows all domains are equally likely; targets are scaled to sum 1; a
target without any document stays unmet; repeated rows stay repeated; an empty
table gives no rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapweave.llm.common import binary_texts, pieces, ship, unpack
from mapweave.llm.features import DIMS, SAMPLE_ROWS, feature_rows, hashed
from mapweave.sources.tables import stage

#: Target shares of tokens by language, for the registered query and the pipeline.
TARGETS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}
#: Steps end at a miss of at most this part of each target (of 0.01 for smaller ones).
TOLERANCE = 1e-3
#: Steps at most, and steps in which the miss must fall by a hundredth.
ROUNDS, STALLED = 300, 30
#: Weight of the penalty on rates away from 1, in the first step; one n-th of it in step n.
KEEP_NEAR = 1e-3
#: Added to the second moments: domains with hardly any document stay unmet instead of making rates explode.
_RIDGE = 1e-6
_SCALE = 10.0


@dataclass
class DomainModel:
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        return _softmax(x @ self.weights * np.float32(_SCALE) + self.bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_domains(x: np.ndarray, y: np.ndarray, n: int, ridge: float = 1e-4, rounds: int = 200, rate: float = 0.05) -> DomainModel:
    """Multinomial logistic regression by Adam steps over the whole sample."""
    one = np.eye(n, dtype=np.float32)[y]
    share = np.maximum(one.mean(axis=0), 1e-3)
    x = x * np.float32(_SCALE)
    w, b = np.zeros((x.shape[1], n), np.float32), np.log(share / share.sum())
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        g = x.T @ (_softmax(x @ w + b) - one) / np.float32(len(x)) + np.float32(ridge) * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - np.float32(rate) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + np.float32(1e-8))
    return DomainModel(w, b.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, domain: Column, names: list[str], rows: int = SAMPLE_ROWS,
          dims: int = DIMS) -> DomainModel | None:
    """Fit on at most ``rows`` documents of the label table.

    ``domain`` is a column of the documents that is read for the labelled rows
    only; rows whose domain is no target are left out.
    """
    place = F.array_position(F.array(*map(F.lit, names)), domain) - 1
    ids = labels.filter("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text"), place.cast("int").alias("label")).join(
        F.broadcast(ids), "doc_id").filter("label >= 0").select("text", "label")
    x, y = feature_rows(sample, rows, dims)
    return fit_domains(x, y, len(names)) if len(y) else None


def with_posteriors(docs: DataFrame, model: DomainModel | None, n: int, rates: Rates | None = None) -> DataFrame:
    """The documents with ``_llm_tokens`` and ``_llm_posterior``, and ``_llm_rate`` where the rule of the rates is known."""
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("_llm_tokens", T.LongType()),
                           T.StructField("_llm_posterior", T.ArrayType(T.DoubleType())),
                           *([T.StructField("_llm_rate", T.DoubleType())] if rates else [])])
    shipped = ship(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = unpack(shipped)
        for batch in pieces(batches):
            texts = binary_texts(batch.column(at))
            p = np.full((len(texts), n), 1.0 / n)
            if fitted is not None:
                for s in range(0, len(texts), 1000):
                    p[s:s + 1000] = fitted.posteriors(hashed(texts[s:s + 1000], len(fitted.weights)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * n, pa.int32()), pa.array(p.ravel()))
            tokens = pa.array([len(t.split()) for t in texts], pa.int64())
            rate = [pa.array(rates.of(p))] if rates else []
            yield pa.RecordBatch.from_arrays([*batch.columns, tokens, lists, *rate], names=schema.names)

    return docs.mapInArrow(run, schema)


@dataclass
class Rates:
    """The rule of the rates: the scaled misses of the shares at each step so far."""

    misses: list[np.ndarray] = field(default_factory=list)
    keep_near: float = KEEP_NEAR

    def of(self, p: np.ndarray, ahead: bool = False) -> np.ndarray:
        """Rates after all steps; ``ahead`` gives the point of the next gradient.

        A row's step n is r <- max(0, y - step * (p . miss + keep_near / n * (y - 1)))
        from y, the rates moved on along their last change.
        """
        rate = np.ones(len(p))
        point, t = rate, 1.0
        for n, miss in enumerate(self.misses, 1):
            near = self.keep_near / n
            new = np.maximum(point - (p @ miss + near * (point - 1)) / (1 + near), 0)
            t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
            point, rate, t = new + (t - 1) / t_new * (new - rate), new, t_new
        return point if ahead else rate


def domain_shares(table: DataFrame, rates: Rates, total: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums of rate * tokens * posterior over all rows, by domain, over all tokens: now and ahead."""
    sums = _summed(table, lambda tokens, p: p.T @ np.stack([tokens * rates.of(p), tokens * rates.of(p, True)], 1))
    return tuple(sums.reshape(-1, 2).T / total)


def second_moments(table: DataFrame, total: float) -> np.ndarray:
    """Sums of tokens * posterior * posterior for each two domains, over all tokens."""
    sums = _summed(table, lambda tokens, p: (p * tokens[:, None]).T @ p)
    return sums.reshape(2 * (round(len(sums) ** 0.5),)) / total


def _summed(table: DataFrame, part_of) -> np.ndarray:
    """The sum over all batches of ``part_of(tokens, posteriors)``, as one row of numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            if batch.num_rows:
                part = part_of(*_matrix(batch)).ravel()
                out = part if out is None else out + part
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], names=["i", "v"])

    sums = table.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    return np.array([r.v for r in sorted(sums, key=lambda r: r.i)])


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    tokens = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
    return tokens, batch.column(1).flatten().to_numpy().reshape(len(tokens), -1)


def fit_rates(table: DataFrame, target: np.ndarray, rounds: int = ROUNDS) -> Rates:
    """Projected gradient steps over (_llm_tokens, _llm_posterior) rows."""
    table = table.select("_llm_tokens", "_llm_posterior").filter("_llm_tokens > 0")
    total = table.agg(F.sum("_llm_tokens")).first()[0]
    rates = Rates()
    if not total:
        return rates
    scale = np.linalg.inv(second_moments(table, float(total)) + _RIDGE * np.eye(len(target)))
    allowed = TOLERANCE * np.maximum(target, 0.01)
    best, since = np.inf, 0
    while True:
        now, ahead = domain_shares(table, rates, float(total))
        worst = np.max(np.abs(now - target) / allowed)
        if worst <= 1:
            return rates
        best, since = (worst, 0) if worst < 0.99 * best else (best, since + 1)
        if len(rates.misses) >= rounds or since >= STALLED:
            warnings.warn(f"targets {target.tolist()} are not met: shares are {now.round(5).tolist()}", stacklevel=2)
            return rates
        rates.misses.append(scale @ (ahead - target))


def with_rates(table: DataFrame, rates: Rates) -> DataFrame:
    """The table with ``_llm_rate``."""
    schema = T.StructType([*table.schema.fields, T.StructField("_llm_rate", T.DoubleType())])
    places = [table.columns.index(c) for c in ("_llm_tokens", "_llm_posterior")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, p = _matrix(batch.select(places))
            rate = rates.of(p) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], names=schema.names)

    return table.mapInArrow(run, schema)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain: Column, rounds: int = ROUNDS,
        carry: bool = False) -> DataFrame:
    """Rates of all documents: doc_id (or all columns), tokens, domain shares and rate.

    ``carry`` keeps the columns of the documents; otherwise only the id is staged.
    """
    names = sorted(targets)
    target = np.array([targets[n] for n in names], float)
    target = target / target.sum()
    model = train(docs, labels, domain, names)
    kept = docs.columns if carry else ["doc_id"]
    # Rounds the rate of a row: by id and text, and by place, since rows can agree in both.
    place = F.xxhash64("doc_id", F.col("text").cast("string"), F.monotonically_increasing_id())
    placed = (docs if carry else docs.select("doc_id", "text")).withColumn("_llm_place", place)
    if carry:
        # Rates need two passes; the texts are scored again in the second instead of being copied.
        table = stage(with_posteriors(docs.select("text"), model, len(names)).drop("text"), "mix-posteriors")
        rated = with_posteriors(placed, model, len(names), fit_rates(table, target, rounds))
    else:
        table = stage(with_posteriors(placed, model, len(names)).drop("text"), "mix-posteriors")
        rated = with_rates(table, fit_rates(table, target, rounds))
    added = {"n_tokens": F.col("_llm_tokens"), **{f"p_{n}": F.col("_llm_posterior")[i] for i, n in enumerate(names)},
             "rate": F.col("_llm_rate"), "copies": _copies()}
    taken = {c.lower() for c in kept}
    # A column of the documents keeps its name; a result of that name is called mix_<name>.
    return rated.select(*[f"`{c}`" for c in kept], *[
        value.alias(name if name not in taken else f"mix_{name}") for name, value in added.items()])


def _copies() -> Column:
    """Whole copies: the rate rounded up or down by a hash of the row, right on average."""
    chance = F.pmod("_llm_place", F.lit(1 << 20)) / float(1 << 20)
    return (F.floor("_llm_rate") + (chance < F.col("_llm_rate") - F.floor("_llm_rate")).cast("long"))


def mixed_corpus(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain: Column) -> DataFrame:
    """The documents as often as their rates say, with the columns of `mix` and ``copy``, the number of a repeat."""
    rated = mix(docs, labels, targets, domain, carry=True)
    taken = {c.lower() for c in docs.columns}
    copies, copy = (n if n not in taken else f"mix_{n}" for n in ("copies", "copy"))
    return rated.filter(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))

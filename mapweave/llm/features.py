"""Hashed text features and bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import binary_texts, pieces, slices

DIMS = 2048
#: Labelled rows that a classifier is fitted on, at most; the choice is by hash of the id.
SAMPLE_ROWS = 8_000


def hashed(texts: list[bytes], dims: int = DIMS) -> np.ndarray:
    """One row per text: square roots of the shares of hashed runs of 1 to 3 bytes.

    Whole texts are read. An empty text is the zero row.
    """
    out = np.zeros((len(texts), dims), np.float32)
    for a, b in slices(texts):
        data = np.frombuffer(b" ".join(texts[a:b]) + b"   ", np.uint8).astype(np.uint32)
        sizes = np.fromiter(map(len, texts[a:b]), np.int64, b - a)
        row = np.repeat(np.arange(b - a, dtype=np.int64) * dims, sizes + 1)
        ends = np.cumsum(sizes + 1) - 1
        counts = np.zeros((b - a) * dims, np.float32)
        code = np.zeros(len(row), np.uint32)
        for n in range(3):
            code = code * np.uint32(257) + data[n:n + len(row)] + np.uint32(1)
            place = (code * np.uint32(2654435761) >> np.uint32(12)).astype(np.int64) % dims
            inside = np.ones(len(row), bool)
            for back in range(n + 1):
                at = ends - back
                inside[at[at >= 0]] = False
            counts += np.bincount((row + place)[inside], minlength=len(counts)).astype(np.float32)
        counts = counts.reshape(b - a, dims)
        total = counts.sum(axis=1, keepdims=True)
        out[a:b] = np.sqrt(counts / np.maximum(total, 1))
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents.

    ``label`` is taken from the label table; null labels are left out, and a
    document with several labels has the largest. The sampled ids are few by
    construction, so they are broadcast and the documents are not shuffled.
    """
    chosen = (labels.select("doc_id", label.alias("label")).filter("doc_id is not null and label is not null")
              .groupBy("doc_id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select(
        "text", "label")


def feature_rows(sample: DataFrame, rows: int, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Feature matrix and labels of a bounded sample, on the driver.

    Repeated document rows could exceed the bound, so it is applied again.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = hashed(binary_texts(batch.column(0)), dims)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary()), batch.column(1)], names=["x", "label"])

    kind = sample.schema["label"].dataType.simpleString()
    table = sample.mapInArrow(run, f"x binary, label {kind}").limit(rows).toArrow()
    x = np.frombuffer(b"".join(table["x"].to_pylist()), np.float16).astype(np.float32).reshape(-1, dims)
    return x, np.array(table["label"].to_pylist())

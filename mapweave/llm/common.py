"""Helpers that the text operators share: batches, words in byte buffers, bits."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts are handled in slices of about this many bytes; one longer text is a slice.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def ship(spark, model):
    """Broadcast a model with its code, so that executors need no installed copy."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def unpack(shipped):
    """The model of `ship`, in a task."""
    return pickle.loads(shipped.value)


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the id and the text, so that other columns cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def binary_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows, so that no copy of a whole batch of texts is made."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most ``limit`` bytes (or one text)."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each run outside ASCII white space."""
    solid = np.empty(len(data) + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(_SPACE[data], out=solid[1:-1])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    return edge[::2], edge[1::2]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (multiply and xor-shift), element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            grown = []
            for b in (self.base, self.inverse):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                grown.append(np.multiply.accumulate(p))
            self.up, self.down = grown
        return self.up[:n], self.down[:n]


def prefix_hash(values: np.ndarray, powers: Powers) -> np.ndarray:
    """Prefix sums of value * base**index; ranges are compared with `range_hash`."""
    up, _ = powers.upto(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Polynomial hash of values[start:end], the same wherever the range stands."""
    _, down = powers.upto(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start] ^ (end - start).astype(np.uint64) << np.uint64(48))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as a signed integer, for a Spark long."""
    return x.view(np.int64)

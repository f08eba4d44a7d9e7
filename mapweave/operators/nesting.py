"""Nesting of child rows into their parent's record without unbounded groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from mapweave.operators.ordered import running_count
from mapweave.sources.tables import stage


def nest(children: DataFrame, keys: list[str], order_id: str, fields: list[str], name: str,
         slice_rows: int = 10_000) -> DataFrame:
    """Records per key with its children as an array sorted by ``order_id``.

    Children are numbered in the order of ``order_id`` (an integer) and cut after
    every ``slice_rows``: a key has one record per slice, numbered from 0 in
    ``slice_no``, and ``n_items`` is the size of the whole group. No array
    outgrows a slice, no hot key is collected by one task, and all children
    are kept.
    """
    item = F.struct(F.col("_at").alias("_order"), *[F.col(f) for f in fields])
    sliced = _sliced(running_count(children, keys, order_id, "_at"), keys, slice_rows)
    return (sliced.groupBy(*keys, "n_items", "slice_no")
            .agg(F.array_sort(F.collect_list(item)).alias("_items"))
            .withColumn(name, F.transform("_items", lambda x: F.struct(*[x[f].alias(f) for f in fields])))
            .drop("_items"))


def join_text(children: DataFrame, keys: list[str], order_id: str, text: Column, separator: str,
              name: str, slice_rows: int = 10_000) -> DataFrame:
    """Texts of a group joined in the order of the texts, sliced like ``nest``.

    Slices follow each other in text order, so the texts of all slices, put
    together by ``slice_no``, are the sorted group. Equal texts go by ``order_id``.
    """
    rows = children.select(*keys, F.col(order_id).alias("_id"), text.alias("_text"))
    sliced = _sliced(_sorted_positions(rows, keys, ["_text", "_id"]), keys, slice_rows)
    return sliced.groupBy(*keys, "n_items", "slice_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_text"))), lambda x: x["_text"]),
                     separator).alias(name))


def _sorted_positions(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """1-based position ``_at`` within the key by any sortable columns.

    Rows are dealt out by ranges of (key, order), which splits a hot key, and the
    split is written, so that the ranges stay what they are. Positions count
    within a range and go on from the ranges before it.
    """
    placed = stage(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "sorted")
    local = placed.withColumn("_in", F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order)))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = (placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
              .withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n"))
    return local.join(starts, [*keys, "_part"]).withColumn("_at", F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def _sliced(numbered: DataFrame, keys: list[str], slice_rows: int) -> DataFrame:
    """Numbered children with the size of their group and the slice they belong to.

    Sizes are joined on (keys, slice), so that a hot group is spread over the
    tasks of its slices.
    """
    sliced = numbered.withColumn("slice_no", F.floor((F.col("_at") - 1) / slice_rows))
    sizes = sliced.groupBy(*keys, "slice_no").agg(F.count("*").alias("_n"))
    total = sizes.withColumn("n_items", F.sum("_n").over(W.partitionBy(*keys))).drop("_n")
    return sliced.join(total, [*keys, "slice_no"])

"""Order-dependent operators that split a hot group into row ranges.

A window over a whole file puts that file into one task. Here rows are cut
into ranges of ``chunk_rows`` row numbers; windows run per range, and a second
window over one summary row per range carries state across their borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

CHUNK_ROWS = 1 << 16


def running_count(df: DataFrame, keys: list[str], order: str, out: str,
                  chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """1-based position of each row within its group, by the integer ``order``."""
    chunked = df.withColumn("_chunk", F.floor(F.col(order) / chunk_rows))
    local = chunked.withColumn("_pos", F.row_number().over(W.partitionBy(*keys, "_chunk").orderBy(order)))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1))
    starts = (chunked.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
              .withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n"))
    return (local.join(starts, [*keys, "_chunk"])
            .withColumn(out, F.col("_before") + F.col("_pos")).drop("_chunk", "_pos", "_before"))


def islands(df: DataFrame, keys: list[str], order: str, max_gap: int, out: str,
            chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Number the runs of rows whose ``order`` steps by at most ``max_gap``."""
    def gap(previous: Column) -> Column:
        return (F.col(order) - previous > max_gap).cast("bigint")

    inside = W.partitionBy(*keys, "_chunk").orderBy(order)
    chunked = df.withColumn("_chunk", F.floor(F.col(order) / chunk_rows))
    local = chunked.withColumn("_new", F.coalesce(gap(F.lag(order).over(inside)), F.lit(0)))
    across = W.partitionBy(*keys).orderBy("_chunk")
    borders = (local.groupBy(*keys, "_chunk")
               .agg(F.min(order).alias(order), F.max(order).alias("_last"), F.sum("_new").alias("_inner"))
               .withColumn("_head", F.coalesce(gap(F.lag("_last").over(across)), F.lit(1))))
    earlier = F.sum(F.col("_inner") + F.col("_head")).over(across.rowsBetween(W.unboundedPreceding, -1))
    starts = borders.select(*keys, "_chunk", (F.coalesce(earlier, F.lit(0)) + F.col("_head")).alias("_start"))
    seen = F.sum("_new").over(inside.rowsBetween(W.unboundedPreceding, 0))
    return (local.withColumn("_seen", seen).join(starts, [*keys, "_chunk"])
            .withColumn(out, F.col("_start") + F.col("_seen")).drop("_chunk", "_new", "_seen", "_start"))


def join_by_range(rows: DataFrame, tables: DataFrame, keys: list[str], order: str,
                  chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Inner join of rows with one record per group, spread by row range.

    A plain join on the group would bring all rows of a hot one together, and
    an aggregate on the same keys after it keeps AQE from splitting them.
    Joining on (keys, range) costs one record per range instead.
    """
    chunked = rows.withColumn("_chunk", F.floor(F.col(order) / chunk_rows))
    placed = chunked.select(*keys, "_chunk").distinct().join(tables, keys)
    return chunked.join(placed, [*keys, "_chunk"]).drop("_chunk")

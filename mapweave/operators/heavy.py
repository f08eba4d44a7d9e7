"""Heavy hitters: a mergeable sketch names hot keys, and joins treat only those apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters of a sketch; a key with over about 1/12,000 of the rows is always named.
TRACKED = 1 << 14
#: Hot keys at most, the most frequent ones; what is broadcast for them is this many rows.
HOT_KEYS = 1 << 12
#: A key with more rows than this, and with more than one row in `HOT_KEYS`, is hot.
HOT_ROWS = 10_000


def sketch(rows: DataFrame, key: Column, tracked: int = TRACKED) -> DataFrame:
    """(n, keyless, state): one row that can be stored and merged with others; null is no key, and rows of it are ``keyless``."""
    hashed = F.when(key.isNotNull(), F.xxhash64(key)).alias("_hash")
    return rows.select(hashed).agg(F.count("_hash").alias("n"), F.count_if(F.col("_hash").isNull()).alias("keyless"),
                                   F.expr(f"approx_top_k_accumulate(_hash, {tracked})").alias("state"))


def merged(sketches: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """One sketch of the rows of several."""
    return sketches.agg(F.sum("n").alias("n"), F.sum("keyless").alias("keyless"), F.expr(f"approx_top_k_combine(state, {tracked})").alias("state"))


def hot_keys(state: DataFrame, hot_rows: int = HOT_ROWS, most: int = HOT_KEYS) -> DataFrame:
    """(key_hash, rows) of the keys with over ``hot_rows`` rows by the sketch, the most frequent ``most`` at most.

    A count is above the truth by no more than the rows over the counters, so
    some keys may be named that are a little below; none far above is missing.
    """
    found = state.select(F.inline(F.expr(f"approx_top_k_estimate(state, {most})")))
    return found.where(F.col("item").isNotNull() & (F.col("count") > hot_rows)).select(
        F.col("item").alias("key_hash"), F.col("count").alias("rows"))


def weigh(rows: DataFrame, key: Column, hot_rows: int = HOT_ROWS) -> tuple[int, int, int, list[int]]:
    """(rows with a key, rows without, most rows of a key that is not hot, hashes of the hot keys); one scan of the key."""
    state = sketch(rows, key).select("n", "keyless", F.expr(f"approx_top_k_estimate(state, {HOT_KEYS})").alias("top")).head()
    least = max(hot_rows, (state.n + state.keyless) // HOT_KEYS)
    return state.n, state.keyless, least, [x["item"] for x in state.top if x["item"] is not None and x["count"] > least]


def join_grouped(rows: DataFrame, grouped: DataFrame, key: Column, grouped_key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join of rows with a frame that has one row for each ``grouped_key``.

    A sketch of the keys is taken first (one scan of the key, one row to the
    driver). Without a hot key this is a plain join. Else rows of hot keys meet
    at most `HOT_KEYS` broadcast rows where they lie, as do rows without a key
    if they are many; all others are dealt out by their key. A frame that was
    grouped by the key is already dealt out, so the join could not split a hot
    key by itself.
    """
    _, keyless, least, hot = weigh(rows, key, hot_rows)
    if not hot and keyless <= least:
        return rows.join(grouped, key == F.col(grouped_key), "left")
    apart = key.isNull() | F.xxhash64(key).isin(hot)
    few = F.broadcast(grouped.where(F.xxhash64(grouped_key).isin(hot)))
    here = rows.where(apart).join(few, key == F.col(grouped_key), "left")
    return here.union(rows.where(~apart).join(grouped, key == F.col(grouped_key), "left"))

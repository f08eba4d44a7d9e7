"""Lineage over any number of hops, cycles included.

Nodes are compared as wholes: give a (type, id) struct where ids repeat between
types. Edges without a source or target are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.sources.tables import stage


def typed_edges(edges: DataFrame) -> DataFrame:
    """(source, target) as (type, id) structs of lineage rows; ids as text."""
    known = edges.where("source_id IS NOT NULL AND target_id IS NOT NULL")
    return known.select(*[F.struct(F.col(f"{side}_type").alias("type"), F.col(f"{side}_id").cast("string").alias("id")).alias(side)
                          for side in ("source", "target")])


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _doubled(edges: DataFrame) -> DataFrame:
    """The closure of staged (source, target, hops = 1), by doubling the length of ways."""
    parts = [edges]
    longest = 1
    while True:
        known = _together(parts)
        far = known.where(F.col("hops") == longest).select("source", F.col("target").alias("_middle"))
        step = known.select(F.col("source").alias("_middle"), "target", (F.col("hops") + longest).alias("hops"))
        found = far.join(step, "_middle").groupBy("source", "target").agg(F.min("hops").alias("hops"))
        fresh = stage(found.join(known.select("source", "target"), ["source", "target"], "left_anti"), "lineage-pairs")
        if fresh.isEmpty():
            return known
        parts.append(fresh)
        longest *= 2


def closure(edges: DataFrame) -> DataFrame:
    """(source, target, hops): every pair with a way between them and its fewest hops.

    Nodes that nothing leads to are only ever the start of a way. They are peeled
    off, layer by layer while a layer has at least half of the edges left, and
    get their ways at the end from those of their targets, in one join a layer.
    In what is left, lengths double: with all pairs of up to n hops known, those of
    up to 2n are a pair of exactly n hops followed by a known one. So the rounds are
    the logarithm of edges and of the longest way. Each round is written before
    the next one. On a cycle a node reaches itself.
    """
    inner = stage(edges.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target").distinct()
                  .withColumn("hops", F.lit(1)), "lineage-pairs")
    left, layers = inner.count(), []
    while left:
        led_to = inner.select(F.col("target").alias("source")).distinct()
        rest = stage(inner.join(led_to, "source", "left_semi").select("source", "target", "hops"), "lineage-pairs")
        n = rest.count()
        if 2 * n > left:
            break
        layers.append(stage(inner.join(led_to, "source", "left_anti").select("source", "target", "hops"), "lineage-pairs"))
        inner, left = rest, n
    levels = [_doubled(inner)] if left else []
    for layer in reversed(layers):
        # A node of this layer may lead to any layer below it.
        below = _together(levels).select(F.col("source").alias("_middle"), F.col("target").alias("_far"), (F.col("hops") + 1).alias("hops")) if levels else None
        ways = layer if below is None else layer.unionByName(
            layer.select("source", F.col("target").alias("_middle")).join(below, "_middle").select("source", F.col("_far").alias("target"), "hops"))
        levels.append(stage(ways.groupBy("source", "target").agg(F.min("hops").alias("hops")), "lineage-pairs"))
    return _together(levels) if levels else inner


def trace(edges: DataFrame, starts: DataFrame, upstream: bool = True) -> DataFrame:
    """(start, node, hops): what the nodes of ``starts`` (column node) come from, or what comes from them.

    One round a hop over the nodes reached last, so only what hangs together with the starts is read on.
    """
    here, there = ("target", "source") if upstream else ("source", "target")
    steps = edges.select(F.col(here).alias("_at"), F.col(there).alias("node")).dropna().distinct()
    front = starts.select(F.col("node").alias("start"), F.col("node").alias("_at")).dropna().distinct()
    parts: list[DataFrame] = []
    hops = 0
    while True:
        hops += 1
        found = front.join(steps, "_at").select("start", "node").distinct()
        if parts:
            found = found.join(_together(parts).select("start", "node"), ["start", "node"], "left_anti")
        fresh = stage(found.withColumn("hops", F.lit(hops)), "lineage-front")
        if parts and fresh.isEmpty():
            return _together(parts)
        parts.append(fresh)
        front = fresh.select("start", F.col("node").alias("_at"))

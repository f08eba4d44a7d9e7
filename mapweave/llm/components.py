"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.sources.tables import stage


def _minima(links: DataFrame, node: str, other: str) -> DataFrame:
    return links.groupBy(node).agg(F.least(F.min(other), F.col(node)).alias("low"))


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of a node are linked to its smallest neighbour."""
    both = links.select(F.col("src").alias("at"), F.col("dst").alias("to")).union(
        links.select(F.col("dst").alias("at"), F.col("src").alias("to")))
    return both.join(_minima(both, "at", "to"), "at").filter("to > at").select(
        F.col("to").alias("src"), F.col("low").alias("dst")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    low = _minima(links, "src", "dst")
    return links.join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).union(
        low.select("src", F.col("low").alias("dst"))).filter("src <> dst").distinct()


def component_labels(links: DataFrame) -> DataFrame:
    """(node, label) for every linked node; the label is the smallest node.

    ``links`` are (src, dst) with src > dst. Each round is written to the shared
    folder, so lineage stays short. The work ends when a round changes nothing,
    after a number of rounds that grows with the logarithm of the longest chain.
    """
    state = stage(links, "component-links")
    before = None
    while True:
        state = stage(_small_star(_large_star(state)), "component-links")
        now = state.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    # Stars only: each node has one link, to the smallest of its component.
    return state.select(F.col("src").alias("node"), F.col("dst").alias("label")).union(
        state.select(F.col("dst").alias("node"), F.col("dst").alias("label")).distinct())

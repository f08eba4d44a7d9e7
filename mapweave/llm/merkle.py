"""Merkle manifest: digests of rows, of sources and of the whole table, with proofs.

Leaves of a source stand in order of doc_id (null first, then by digest); runs
of 16 nodes make the next level. Places come from one range sort (`places.ranked`).
On each level a window over a run supplies the siblings by lag and lead at fixed
offsets, masked by slot and run length, and the row in slot 0 hashes the parent.
Every level is written, a sixteenth of the one below it. On the way down a node
adds its siblings to the steps of its parent, once per run, so the leaves are
joined with one row for each 16 of them.

Defined cases: a null column is `-`; rows without an id come first; equal ids are
ordered by their digests, and equal rows have equal digests, so any order of
them gives the same tree; a null source is a source of its own, the first; one
leaf is its own subroot, and one subroot the root; without siblings the proof is
the hash of nothing; an empty table gives no rows. Only the five named columns
are hashed, and other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from mapweave.llm.places import ranked
from mapweave.sources.tables import stage

#: Children of a node.
FAN_OUT = 16
#: Columns of a leaf, in this order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: A row is tampered with where this divides the CRC-32 of its id.
TAMPER_EVERY = 5

_STEP = "struct<left: string, right: string>"


def leaf_digest(columns: dict[str, Column]) -> Column:
    """SHA-256 of the named columns, each with its length in bytes, or `-` for null."""
    parts = []
    for name in LEAF_COLUMNS:
        value = columns[name].cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, tree, leaf, shown): the digest of each row and of the row as it is shown to the check."""
    columns = {name: F.col(name) for name in LEAF_COLUMNS}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0
    leaf = leaf_digest(columns)
    changed = leaf_digest(columns | {"text": lower_ascii(F.col("text").cast("string"))})
    # '=' before the name keeps the order of names and sets the null source apart, before all.
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return docs.select("doc_id", tree.alias("tree"), leaf.alias("leaf"), F.when(tampered, changed).otherwise(leaf).alias("shown"))


def with_siblings(nodes: DataFrame, digest: str = "digest") -> DataFrame:
    """``nodes`` (tree, pos, n, digest) with ``run``, ``slot`` and the digests left and right of each in its run."""
    inside = W.partitionBy("tree", "run").orderBy("pos")
    slot, length = F.col("pos") % FAN_OUT, F.least(F.lit(FAN_OUT), F.col("n") - F.col("run") * FAN_OUT)
    cut = nodes.withColumn("run", F.floor(F.col("pos") / FAN_OUT)).withColumn("slot", slot).withColumn("length", length)
    left = [F.when(F.col("slot") >= k, F.lag(digest, k).over(inside)) for k in range(FAN_OUT - 1, 0, -1)]
    right = [F.when(F.col("slot") + k < F.col("length"), F.lead(digest, k).over(inside)) for k in range(1, FAN_OUT)]
    return cut.withColumns({"left": F.concat_ws("", *left), "right": F.concat_ws("", *right)}).drop("length")


def parents(nodes: DataFrame) -> DataFrame:
    """The next level: the row in slot 0 hashes its run."""
    heads = with_siblings(nodes.filter("n > 1")).filter("slot = 0")
    return heads.select("tree", F.col("run").alias("pos"), F.ceil(F.col("n") / FAN_OUT).alias("n"),
                        F.sha2(F.concat("digest", "right"), 256).alias("digest"))


def build(nodes: DataFrame, name: str) -> list[DataFrame]:
    """All levels (tree, pos, n, digest) from ``nodes`` up; a tree ends at the level where its n is 1."""
    levels = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 1
    while most > 1:
        levels.append(stage(parents(levels[-1]), name))
        most = -(-most // FAN_OUT)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, level, digest): the root of each tree."""
    found = [x.filter("n = 1").select("tree", F.lit(i).alias("level"), "digest") for i, x in enumerate(levels)]
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def climb(level: DataFrame, above: DataFrame, digest: str = "digest") -> DataFrame:
    """``level`` with ``steps`` to the root: its siblings first, then the steps of its parent.

    ``above`` holds (tree, run, steps, ...): the parent of each run, and run 0 of trees that end here.
    """
    step = F.when(F.col("n") > 1, F.array(F.struct("left", "right"))).otherwise(F.array().cast(f"array<{_STEP}>"))
    return (with_siblings(level, digest).withColumn("own", step).join(above, ["tree", "run"])
            .withColumn("steps", F.concat("own", "steps")).drop("own", "left", "right", "slot"))


def paths(levels: list[DataFrame], ends: DataFrame, name: str) -> DataFrame:
    """(tree, run, ...): what `climb` needs for the lowest level. ``ends``: (tree, level, ...) of the roots."""
    ended = ends.withColumn("run", F.lit(0).cast("long"))
    last = len(levels) - 1
    above = ended.filter(F.col("level") == last).drop("level")
    for i in range(last, 0, -1):
        climbed = climb(levels[i], above).drop("run", "n", "digest").withColumnRenamed("pos", "run")
        above = stage(climbed.unionByName(ended.filter(F.col("level") == i - 1).drop("level")), name)
    return above


def fold(leaf: Column, steps: Column) -> Column:
    """The root that follows from a leaf and the siblings on its way."""
    return F.aggregate(steps, leaf, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, steps) of every row."""
    rows = stage(leaves(docs), "merkle-leaves")
    placed = stage(ranked(rows, "tree", [F.col("doc_id").asc_nulls_first(), F.col("leaf")], "merkle-order"), "merkle-places")
    levels = build(placed.select("tree", "pos", "n", F.col("leaf").alias("digest")), "merkle-level")
    subroots = stage(tops(levels), "merkle-subroots")
    # The subroots are the leaves of one more tree.
    sources = stage(ranked(subroots.select(F.lit("").alias("all"), F.col("tree").alias("source"), "level", "digest"),
                           "all", [F.col("source")], "merkle-source-order"), "merkle-sources")
    forest = build(sources.select(F.col("all").alias("tree"), "pos", "n", "digest"), "merkle-source-level")
    found = tops(forest).first()
    root = F.lit(found["digest"] if found else None).cast("string")
    none = F.array().cast(f"array<{_STEP}>")
    over = paths(forest, tops(forest).select("tree", "level", none.alias("steps")), "merkle-source-path")
    lowest = sources.select(F.col("all").alias("tree"), "pos", "n", "source", "level", "digest")
    ends = climb(lowest, over).select(F.col("source").alias("tree"), "level", F.col("digest").alias("subroot"), "steps")
    above = paths(levels, stage(ends, "merkle-ends"), "merkle-path")
    found = climb(placed, above, "leaf")
    proof = F.concat(F.lit(""), F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), ""))
    folded = found.withColumn("root", root).withColumn("folded_root", fold(F.col("shown"), F.col("steps")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"), "steps")

"""Merkle manifest against a plain tree, and proofs that a reader can check."""

import hashlib
import random
import zlib
from collections import defaultdict

from mapweave.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, tampered=False):
    *head, text = row
    if tampered and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*head, text)))


def plain_tree(nodes):
    """The root, and for each leaf its siblings (left, right) level by level."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            run = nodes[place // 16 * 16:place // 16 * 16 + 16]
            steps[i].append(("".join(run[:place % 16]), "".join(run[place % 16 + 1:])))
        nodes = [sha("".join(nodes[i:i + 16])) for i in range(0, len(nodes), 16)]
        at = [place // 16 for place in at]
    return nodes[0], steps


def plain_manifest(rows):
    by = defaultdict(list)
    for row in rows:
        by[row[1]].append(row)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[s] = plain_tree([plain_leaf(r) for r in by[s]])
    root, over = plain_tree([trees[s][0] for s in sources])
    out = []
    for s, upper in zip(sources, over):
        for row, lower in zip(by[s], trees[s][1]):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            at = plain_leaf(row, tampered)
            for left, right in lower + upper:
                at = sha(left + at + right)
            proof = sha("".join(a + b for a, b in lower + upper))
            out.append((row[0], plain_leaf(row), trees[s][0], root, proof, at, at == root))
    return sorted(out, key=repr)


def shown(frame):
    return sorted((tuple(r)[:7] for r in frame.collect()), key=repr)


def test_manifest(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice(["a", "b", "é", "", "Z"]), rng.choice(["en", None]), i * 3, rng.choice(["Abc", "abc", "", None, "ß X"]))
            for i in range(400)]
    rows += [(i, f"one-{i}", None, None, None) for i in range(40)]  # single leaves, more than one level of sources
    rows += [(None, None, None, None, "Same")] * 30 + [(7, "a", "en", 1, "Two")] * 3  # repeated rows, null id and source
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as tree", "5 as pos", "6 as leaf")
    assert shown(merkle.manifest(frame)) == plain_manifest(rows)


def test_hot_source_of_three_levels(spark):
    rows = [(i, "hot" if i % 20 else f"s{i % 7}", "en", i, f"Text {i}") for i in range(4200)]
    found = shown(merkle.manifest(spark.createDataFrame(rows, SCHEMA)))
    assert found == plain_manifest(rows)
    # Tampering shows wherever lower-casing changes the text.
    assert sum(not r[6] for r in found) == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(4200))


def test_small_tables(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(3, "a", "en", 1, "x")]
    only = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).first()
    assert only["leaf"] == only["subroot"] == only["root"] == only["folded_root"]
    assert only["proof_sha256"] == sha("") and shown(merkle.manifest(spark.createDataFrame(rows, SCHEMA))) == plain_manifest(rows)

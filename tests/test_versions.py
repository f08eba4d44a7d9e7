import random

import pytest
from pyspark.sql import functions as F

from mapweave.operators import lineage
from mapweave.operators.audit import current_state
from mapweave.sources.tables import Folders, scratch, stage
from mapweave.sources.versions import ConflictError, VersionedTable
from mapweave.streaming.state import keep_state

COLUMNS = "k int, v string, at int"


def table(spark, path, rows, buckets=8):
    return VersionedTable.create(spark.createDataFrame(rows, COLUMNS), str(path), "k", buckets)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_changes_and_old_versions(spark, tmp_path):
    t = table(spark, tmp_path / "t", [(i, f"v{i}", 0) for i in range(20)] + [(None, "none", 0), (3, "again", 0)])
    t.replace(spark.createDataFrame([(3, "new", 1), (3, "newer", 1), (99, "more", 1), (None, "other", 1)], COLUMNS))
    t.delete(spark.createDataFrame([(7,), (8,), (1234,)], "k int"))
    want = sorted([(i, f"v{i}", 0) for i in range(20) if i not in (3, 7, 8)]
                  + [(3, "new", 1), (3, "newer", 1), (99, "more", 1), (None, "other", 1)], key=repr)
    again = VersionedTable(spark, str(tmp_path / "t"))
    assert rows(again.read()) == want and again.version() == 2
    assert len(rows(again.read(0))) == 22 and len(rows(again.read(1))) == 24 - 1
    t.patch(spark.createDataFrame([(99, ["v"], None, 5), (1, ["at"], "x", 5)], "k int, given array<string>, v string, at int"), ["v", "at"])
    got = rows(t.read())
    assert (99, None, 1) in got and (1, "v1", 5) in got and len(got) == len(want)
    assert t.replace(spark.createDataFrame([], COLUMNS)) == 3
    t.expire(keep=1)
    assert rows(t.read()) == got


def test_emptied_and_empty(spark, tmp_path):
    t = table(spark, tmp_path / "t", [], 2)
    assert rows(t.read()) == [] and t.read().columns == ["k", "v", "at"]
    t.upsert(spark.createDataFrame([(1, "a", 1)], COLUMNS), ["at"])
    t.delete(spark.createDataFrame([(1,)], "k int"))
    assert rows(t.read()) == [] and rows(t.read(1)) == [(1, "a", 1)]


def test_a_failing_writer_leaves_nothing(spark, tmp_path):
    t = table(spark, tmp_path / "t", [(i, "old", 0) for i in range(50)])
    before = rows(t.read())
    bad = spark.range(50).select(F.col("id").cast("int").alias("k"), F.when(F.col("id") < 40, "new")
                                 .otherwise(F.raise_error(F.lit("lost"))).alias("v"), F.lit(1).alias("at"))
    with pytest.raises(Exception, match="lost"):
        t.replace(bad)
    # Dying between the rows and the version.
    claim, t.folders.claim = t.folders.claim, lambda *_: (_ for _ in ()).throw(OSError("gone"))
    with pytest.raises(OSError):
        t.replace(spark.createDataFrame([(1, "half", 1)], COLUMNS))
    t.folders.claim = claim
    assert rows(t.read()) == before and t.version() == 0
    t.replace(spark.createDataFrame([(1, "whole", 1)], COLUMNS))
    assert (1, "whole", 1) in rows(t.read()) and t.version() == 1


def test_concurrent_writers(spark, tmp_path):
    t = table(spark, tmp_path / "t", [(i, "old", 0) for i in range(64)], 16)
    other = VersionedTable(spark, str(tmp_path / "t"))
    bucket = {r.k: r.b for r in t.read().select("k", t._bucket().alias("b")).collect()}
    apart = next(k for k in bucket if bucket[k] != bucket[0])
    same = next(k for k in bucket if k and bucket[k] == bucket[0])

    def meanwhile(key):
        claim = t.folders.claim

        def late(*paths):
            t.folders.claim = claim
            other.replace(spark.createDataFrame([(key, "theirs", 1)], COLUMNS))
            return claim(*paths)
        t.folders.claim = late

    meanwhile(apart)  # other buckets: both changes hold, without working it out again
    t.replace(spark.createDataFrame([(0, "ours", 1)], COLUMNS), attempts=1)
    got = rows(t.read())
    assert (0, "ours", 1) in got and (apart, "theirs", 1) in got and len(got) == 64 and t.version() == 2
    meanwhile(same)  # the same bucket: worked out again over their version
    t.replace(spark.createDataFrame([(0, "ours again", 1)], COLUMNS))
    got = rows(t.read())
    assert (0, "ours again", 1) in got and (same, "theirs", 1) in got and len(got) == 64 and t.version() == 4
    meanwhile(same)
    with pytest.raises(ConflictError):
        t.replace(spark.createDataFrame([(0, "late", 1)], COLUMNS), attempts=1)
    assert len(rows(t.read())) == 64 and (0, "ours again", 1) in rows(t.read())


def test_state_kept_by_a_stream(spark, tmp_path):
    rng = random.Random(5)
    changes = [(rng.choice([None, 1, 1, 1, *range(2, 30)]), f"v{rng.randrange(40)}", rng.randrange(15)) for _ in range(300)]
    df = spark.createDataFrame(changes, COLUMNS)
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    t = table(spark, tmp_path / "t", [(2, "stored", 100)])
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    keep_state(stream, t, ["at"], str(tmp_path / "cp")).awaitTermination()
    assert t.version() == 5
    both = df.unionByName(spark.createDataFrame([(2, "stored", 100)], COLUMNS))
    want = rows(current_state(both, "k", F.struct("at", "k", "v")).select("k", "v", "at"))
    assert rows(t.read()) == want
    t.upsert(df.limit(100), ["at"])  # a batch that runs again
    assert rows(t.read()) == want


def test_scratch_removes_what_was_staged(spark):
    with scratch(spark):
        kept = stage(spark.range(5), "gone")
        path = kept.inputFiles()[0].rpartition("/")[0]
        assert Folders(spark).names(path)
    assert Folders(spark).names(path) == []


def reached(pairs):
    steps, out = {}, {}
    for a, b in pairs:
        steps.setdefault(a, set()).add(b)
    for start in steps:
        front, hops = {start}, 0
        while front:
            hops += 1
            front = {n for f in front for n in steps.get(f, ()) if (start, n) not in out}
            out.update({(start, n): hops for n in front})
    return out


@pytest.mark.parametrize("seed", range(3))
def test_lineage_over_many_hops(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"a{i}", f"a{i + 1}") for i in range(21)] + [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("s", "s")]
    pairs += [(f"r{rng.randrange(25)}", f"r{rng.randrange(25)}") for _ in range(30)] + [("a1", "a2"), ("a3", "c2")]
    edges = spark.createDataFrame([*pairs, (None, "a1"), ("a1", None)], "source string, target string")
    want = reached(pairs)
    assert {(r.source, r.target): r.hops for r in lineage.closure(edges).collect()} == want
    starts = spark.createDataFrame([("a21",), ("c1",), ("r3",), ("nowhere",), (None,), ("c1",)], "node string")
    for upstream in (True, False):
        got = {(r.start, r.node): r.hops for r in lineage.trace(edges, starts, upstream).collect()}
        assert got == {(a, b): h for (x, y), h in want.items() for a, b in [(y, x) if upstream else (x, y)]
                       if a in ("a21", "c1", "r3")}


def test_closure_doubles_only_what_is_led_to(spark, monkeypatch):
    """Nodes that nothing leads to, and then those that only they lead to, take no part in the rounds."""
    pairs = [(f"o{i}", f"c{i % 40}") for i in range(400)] + [(f"c{i}", f"n{i % 5}") for i in range(40)] + [("o1", "n2"), ("o3", "c5")]
    pairs += [("n0", "n1"), ("n1", "n2"), ("n2", "n0"), ("n3", "n4"), ("n4", "r")]
    seen, doubled = [], lineage._doubled
    monkeypatch.setattr(lineage, "_doubled", lambda edges: seen.append(edges.count()) or doubled(edges))
    got = lineage.closure(spark.createDataFrame(pairs, "source string, target string")).collect()
    assert {(r.source, r.target): r.hops for r in got} == reached(pairs) and len(got) == len(reached(pairs))
    assert seen == [5]
    # A graph without a cycle is peeled off in full.
    tree = [(f"t{i}", f"t{(i - 1) // 4}") for i in range(1, 400)]
    got = lineage.closure(spark.createDataFrame(tree, "source string, target string")).collect()
    assert {(r.source, r.target): r.hops for r in got} == reached(tree) and seen == [5]


def test_lineage_without_edges(spark):
    edges = lineage.typed_edges(spark.createDataFrame([], "source_type string, source_id int, target_type string, target_id int"))
    assert lineage.closure(edges).count() == 0
    assert lineage.trace(edges, edges.select(F.col("source").alias("node"))).count() == 0

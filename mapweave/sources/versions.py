"""Keyed datasets that change as a whole: a change is seen entirely or not at all.

Rows lie in folders, one per hash bucket of the key and change. A version is a
small table that says which folder holds each bucket. A change writes new
folders for the buckets it touches and then names them in the next version,
which appears by one rename that fails if that version exists. So a reader stays
at one version, a writer that dies leaves nothing to be seen, and of two writers
at once the later one builds on the other's version: as it is if their buckets
differ, else by working out its change anew.

The file system must rename folders atomically and refuse existing targets
(HDFS does; the local one checks first, which suits tests).
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mapweave.operators.audit import current_state, patch
from mapweave.sources.tables import Folders, scratch, stage

_BUCKET = "_versioned_bucket"


class ConflictError(RuntimeError):
    """Another writer changed the same buckets first."""


class VersionedTable:
    """A dataset with one key column; null is a key like any other."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.folders = spark, path, Folders(spark)
        facts = spark.read.schema("key string, buckets int, columns string").parquet(f"{path}/facts").head()
        self.key, self.buckets = facts.key, facts.buckets
        self.schema = StructType.fromJson(json.loads(facts.columns))

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int = 64) -> VersionedTable:
        """Version 0. A change rewrites the buckets it touches, so more buckets mean smaller changes."""
        spark = rows.sparkSession
        spark.createDataFrame([(key, buckets, rows.schema.json())], "key string, buckets int, columns string").coalesce(
            1).write.parquet(f"{path}/facts")
        table = cls(spark, path)
        table._commit(rows, range(buckets), -1)
        return table

    def version(self) -> int:
        """The newest version."""
        found = [int(name) for name in self.folders.names(f"{self.path}/versions") if re.fullmatch("[0-9]+", name)]
        return max(found, default=-1)

    def _held(self, version: int) -> dict[int, tuple[str | None, int]]:
        """Folder and version of the last change by bucket; one row for each bucket."""
        if version < 0:
            return {}
        rows = self.spark.read.schema("bucket int, folder string, changed long").parquet(f"{self.path}/versions/{version}")
        return {r.bucket: (r.folder, r.changed) for r in rows.collect()}

    def read(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """All rows of one version (the newest), or those of some buckets."""
        held = self._held(self.version() if version is None else version)
        paths = [f"{self.path}/data/{folder}/{_BUCKET}={b}" for b, (folder, _) in sorted(held.items())
                 if folder and (buckets is None or b in buckets)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _commit(self, rows: DataFrame, touched, base: int) -> int:
        """Make ``rows`` all rows of the touched buckets, on top of version ``base``."""
        folder = uuid.uuid4().hex
        # A hot bucket is split over files by the rebalance.
        (rows.select(*self.schema.names).withColumn(_BUCKET, self._bucket()).hint("rebalance", _BUCKET)
         .write.partitionBy(_BUCKET).parquet(f"{self.path}/data/{folder}"))
        filled = {int(name.partition("=")[2]) for name in self.folders.names(f"{self.path}/data/{folder}")
                  if name.startswith(_BUCKET + "=")}
        while True:
            held, number = self._held(base), base + 1
            held.update({b: (folder if b in filled else None, number) for b in touched})
            pending = f"{self.path}/pending/{uuid.uuid4().hex}"
            self.spark.createDataFrame([(b, f, n) for b, (f, n) in sorted(held.items())],
                                       "bucket int, folder string, changed long").coalesce(1).write.parquet(pending)
            if self.folders.claim(pending, f"{self.path}/versions/{number}"):
                return number
            self.folders.delete(pending)
            latest = self.version()
            if any(changed > base for b, (_, changed) in self._held(latest).items() if b in touched):
                self.folders.delete(f"{self.path}/data/{folder}")
                raise ConflictError(f"buckets changed after version {base}")
            base = latest

    def _change(self, fresh: DataFrame, result: Callable[[DataFrame, DataFrame], DataFrame], attempts: int) -> int:
        """Commit result(stored, fresh) over the buckets of ``fresh``; returns the new version."""
        with scratch(self.spark):
            kept = stage(fresh, "change")
            touched = {r[0] for r in kept.select(self._bucket()).distinct().collect()}
            for attempt in range(attempts):
                base = self.version()
                if not touched:
                    return base
                try:
                    return self._commit(result(self.read(base, touched), kept), touched, base)
                except ConflictError:
                    if attempt + 1 == attempts:
                        raise
        raise ValueError("attempts must be positive")

    def replace(self, fresh: DataFrame, attempts: int = 5) -> int:
        """The rows of each key in ``fresh`` take the place of all stored rows of that key."""
        return self._change(fresh, lambda stored, new: self._without(stored, new).unionByName(new), attempts)

    def delete(self, keys: DataFrame, attempts: int = 5) -> int:
        """Drop all rows of the given keys."""
        return self._change(keys.select(self.key), self._without, attempts)

    def upsert(self, fresh: DataFrame, at: list[str], attempts: int = 5) -> int:
        """One row per key: the greatest by the columns ``at``, then by all others.

        So the outcome is the same in whatever order and however often changes come.
        """
        order = F.struct(*at, *[c for c in self.schema.names if c not in at])
        return self._change(fresh, lambda stored, new: current_state(stored.unionByName(new), self.key, order), attempts)

    def patch(self, changes: DataFrame, fields: list[str], attempts: int = 5) -> int:
        """Partial updates, as `mapweave.operators.audit.patch` applies them."""
        return self._change(changes, lambda stored, new: patch(stored, new, self.key, fields), attempts)

    def _without(self, stored: DataFrame, keys: DataFrame) -> DataFrame:
        gone = keys.select(F.col(self.key).alias("_gone")).distinct()
        return stored.join(gone, F.col(self.key).eqNullSafe(F.col("_gone")), "left_anti")

    def expire(self, keep: int = 10) -> None:
        """Delete the rows that only versions before the newest ``keep`` hold; those versions can't be read any more.

        Folders that no version names are left alone: a writer may be about to.
        """
        newest = self.version()
        if keep < 1 or newest - keep < 0:
            return
        needed = {folder for v in range(newest - keep + 1, newest + 1) for folder, _ in self._held(v).values()}
        stale = {folder for v in range(newest - keep + 1) for folder, _ in self._held(v).values()} - needed - {None}
        present = set(self.folders.names(f"{self.path}/data"))
        for folder in stale & present:
            self.folders.delete(f"{self.path}/data/{folder}")

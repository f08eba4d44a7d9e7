"""Append-only and replaceable parquet datasets."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.session import shared_dir


def append(df: DataFrame, path: str, *partition_by: str) -> None:
    """Append rows to a dataset; one commit per run."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_by_day(df: DataFrame, path: str, at: str) -> None:
    """Append rows partitioned by the day of ``at``.

    The rebalance hint gathers each day into few files and lets AQE split a
    day that holds most of the rows.
    """
    dated = df.withColumn("day", F.to_date(at)).hint("rebalance", "day")
    append(dated, path, "day")


def replace_partitions(df: DataFrame, path: str, key: str) -> None:
    """Overwrite only the partitions of ``key`` that occur in ``df``."""
    (df.hint("rebalance", key).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path))


class Folders:
    """The folders of a path's file system, through Hadoop's interface."""

    def __init__(self, spark: SparkSession) -> None:
        self._jvm, self._context = spark.sparkContext._jvm, spark.sparkContext
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _system(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self._conf)

    def names(self, path: str) -> list[str]:
        """Names of what lies in a folder; none if it does not exist."""
        where, system = self._system(path)
        return [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []

    def delete(self, path: str) -> None:
        where, system = self._system(path)
        system.delete(where, True)

    def claim(self, source: str, target: str) -> bool:
        """Rename a folder, unless the target exists; says whether it was renamed."""
        hadoop = self._jvm.org.apache.hadoop.fs
        start, system = self._system(source)
        end = hadoop.Path(target)
        system.mkdirs(end.getParent())
        option = getattr(hadoop, "Options$Rename")
        options = self._context._gateway.new_array(option, 1)
        options[0] = option.NONE
        try:
            hadoop.FileContext.getFileContext(start.toUri(), self._conf).rename(start, end, options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            return False
        return True


_STAGED: ContextVar[list[str] | None] = ContextVar("staged", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at its end what was staged within; results must be written by then."""
    token = _STAGED.set([])
    try:
        yield
    finally:
        folders = Folders(spark)
        for path in _STAGED.get():
            folders.delete(path)
        _STAGED.reset(token)


#: With this setting Spark deletes the shuffles of a query at its end, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_COMPACT = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6", "parquet.page.size": str(8 << 20)}
#: Folders that `stage` has written.
_WRITTEN: set[str] = set()


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """The queries within leave no shuffle files behind."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame, name: str, compact: bool = False) -> DataFrame:
    """Write an intermediate that several plans use, and read it back.

    It lives below ``spark.checkpoint.dir``, so it outlasts lost executors, and
    stays until the `scratch` around it ends, if there is one, or `drop_staged`.
    A ``compact`` one is packed closer and leaves no shuffle files.
    """
    path = shared_dir(df.sparkSession, name)
    if (staged := _STAGED.get()) is not None:
        staged.append(path)
    _WRITTEN.add(path)
    if compact:
        with brief_shuffles(df.sparkSession):
            df.write.options(**_COMPACT).parquet(path)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(done: DataFrame, *needed: DataFrame) -> None:
    """Delete the staged folders that ``done`` reads and none of ``needed`` does."""
    def folders(df: DataFrame) -> set[str]:
        return {part for file in df.inputFiles() for part in file.split("/")}

    gone = folders(done).difference(*map(folders, needed))
    for path in [path for path in _WRITTEN if path.rpartition("/")[2] in gone]:
        Folders(done.sparkSession).delete(path)
        _WRITTEN.remove(path)

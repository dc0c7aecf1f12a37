"""Tables that several steps of one operator share, in the folder the cluster names in ``spark.checkpoint.dir``.

Shuffle files die with their executor; a written table does not, and it cuts the lineage. A :class:`Scope` writes such
tables, and deletes all but the kept one when the operator is done.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. Only where the session names none and all runs on one machine, as in tests, a temporary one is
    set; on a cluster executors wouldn't see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or a local path, as workers open it."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store Spark can reach."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Of rows that hold whole texts or runs, a Python worker gets so many bytes at once.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(BATCH[0], None)
    spark.conf.set(*BATCH)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH[0])
        else:
            spark.conf.set(BATCH[0], before)


def bound_batches(spark: SparkSession) -> None:
    """The same bound for the rest of the session, where none that is lower is set. Operators whose result is computed
    when it is read need it then."""
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH[0])) > int(BATCH[1]):
        spark.conf.set(*BATCH)


_kept: list[str] = []


def drop_results(spark: SparkSession) -> None:
    """Delete the tables of all results that operators have given so far in this process; they can't be read any more."""
    while _kept:
        delete(spark, _kept.pop())


class Scope:
    """``with Scope(spark) as s``: ``s.table(df)`` writes a table and gives it back as read; ``s.keep(df)`` likewise,
    but that table outlives the scope. Inside, Arrow batches are small."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/textloom-{uuid.uuid4().hex}"
        self.kept = self.root + "-kept"
        self.made = 0

    def __enter__(self) -> Scope:
        self.batches = small_batches(self.spark)
        self.batches.__enter__()
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.batches.__exit__(None, None, None)
        delete(self.spark, self.root)
        if error is not None:
            delete(self.spark, self.kept)

    def _write(self, df: DataFrame, root: str) -> DataFrame:
        self.made += 1
        path = f"{root}/t{self.made}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def table(self, df: DataFrame, parts: int | None = None) -> DataFrame:
        """``parts``: tasks of the last stage, and files at most; give it only where the rows to write are known."""
        return self._write(df if parts is None else df.coalesce(parts), self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        if self.kept not in _kept:
            _kept.append(self.kept)
        return self._write(df, self.kept)

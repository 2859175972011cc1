"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few id columns that a broadcast may hold (about 20 MB as a table).
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session, or the folder set with
    setCheckpointDir().  Where neither is set, a session on one machine (master
    local) takes a temporary folder; on a cluster that is an error, as executors
    don't see each other's disks."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        base = context.getCheckpointDir()
    return base.rstrip("/")


_scopes: list[list[str]] = []


def new_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes and not keep:
        _scopes[-1].append(path)
    return path


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was written inside it without `keep`; its rows must
    have been used by then."""
    _scopes.append([])
    try:
        yield
    finally:
        drop(spark, *_scopes.pop())


def written(df: DataFrame, name: str, keep: bool = False) -> tuple[DataFrame, str]:
    """The rows of `df`, written once as Parquet and read back: lineage ends
    here, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name, keep)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Removes written tables that no later step reads."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if a count shows at most `rows` rows; else as
    it is, for a shuffled join.  For narrow written tables only, of which the
    count reads no column."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


@contextlib.contextmanager
def arrow_bytes(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """Batches of at most about so many bytes between Spark and Python for the jobs
    that run inside it, so that long texts don't add up in an executor's memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, f"{most}b")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)

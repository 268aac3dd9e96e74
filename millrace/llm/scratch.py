"""Shared scratch tables: lineage is cut by writing Parquet, never by local checkpoints."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one where that is unset and Spark runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local[") and spark.conf.get("spark.master", "") != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        root = _own.setdefault(spark.conf.get("spark.app.id", ""), "") or "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        _own[spark.conf.get("spark.app.id", "")] = root
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; it is not reused by any later call."""
    return f"{scratch_root(spark)}/millrace-{tag}-{uuid.uuid4().hex}"


def tasks_for(spark: SparkSession, rows: int, each: int) -> int:
    """Tasks enough for so many rows: one for ``each`` of them, and no fewer than run at once."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def written(df: DataFrame, tag: str, tasks: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back, so that a lost executor costs no recomputation.

    With ``tasks``, no more than so many write it, where a session has more
    shuffle partitions than the rows need.
    """
    path = scratch_path(df.sparkSession, tag)
    df = df if tasks is None else df.coalesce(tasks)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.scratch)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go when the query that wrote them ends, not when the driver happens to collect its garbage.

    For steps that end in written tables: a frame made here that shuffles should
    not be run twice itself, as its shuffles would be made again.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)

"""Intermediate results where every executor can read them: spark.checkpoint.dir, whatever needs it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TASK_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints: the cluster's own.  Where none is set, local mode takes a temporary one; a cluster
    has no folder of this machine's that its executors could read, so that is an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set")
        context.setCheckpointDir(own or tempfile.mkdtemp(prefix="lodestone-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Computes ``df`` once; later reads come from the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(*frames: DataFrame) -> None:
    """Deletes the files of ``checkpointed`` frames that nothing reads any more."""
    for df in frames:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            drop_path(df.sparkSession, file.get())


def tasks(spark: SparkSession, rows: int) -> int:
    """Into how many partitions so many rows go, that a task's memory doesn't grow with them."""
    return max(spark.sparkContext.defaultParallelism, -(-int(rows) // TASK_ROWS))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

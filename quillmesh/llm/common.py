"""What the training-data operators share: reading, the shared folder, written tables."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 1000  # texts that pass to Python together; Spark's own 10,000 may be hundreds of MB


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of an Arrow batch in this session, unless it has a lower bound already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def free_memory() -> None:
    """Gives what this worker has freed back to the system. Workers live on from task to task, and so would their peaks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def freeing(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``task`` over batches, which frees its memory at its end."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            free_memory()

    return run


def partitions(df: DataFrame, size: int) -> int:
    """How many partitions of about ``size`` bytes ``df`` makes by Spark's estimate of it, the session's number at least."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(-(-estimate // size), 1_000_000))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; from here on the session passes texts in small batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    Where it is unset, as in a local session, a temporary folder is set as the
    checkpoint folder; a cluster must name one.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillmesh-"))
    return sc.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when this session's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            dropped(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            pass

    atexit.register(remove)
    return path


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a table of the shared folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, path: str | None = None, clean: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage is cut, and lost executors lose nothing.

    With ``clean`` the write's shuffle files go at its end and not when Spark happens to collect them.
    """
    spark = df.sparkSession
    path = path or shared_path(spark, name)
    before = spark.conf.get(_CLEAN, "false")
    if clean:
        spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if clean:
            spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)

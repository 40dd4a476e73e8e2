"""The folder that the driver and all executors share, and tables written to it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """From ``spark.checkpoint.dir``, which a cluster must name; a local session without it has a temporary folder."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillmesh-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; it is removed when this session's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            pass

    atexit.register(remove)
    return path


def _at(spark: SparkSession, path: str):
    """(file system, path)"""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _at(spark, path)
    return system.exists(at)


def fingerprint(spark: SparkSession, path: str) -> int:
    """Of the names, sizes and times of what is in a folder."""
    system, at = _at(spark, path)
    return hash(tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in system.listStatus(at))))


def removed(spark: SparkSession, path: str) -> bool:
    """Removes a folder with all in it; whether there was one."""
    system, at = _at(spark, path)
    return system.delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared folder: its lineage is cut, and lost executors lose nothing."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

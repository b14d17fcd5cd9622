"""The folder that driver and executors share, and tables written into it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: Shuffle files go when the query that wrote them has ended, not when the driver's garbage is collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a folder of our own, but only if driver
    and executors are one process: other executors would not see it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="slipweave-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def materialize(frame: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write once to the shared folder and read back: lineage ends there, so a
    lost executor costs a re-read and never a second, different evaluation. A table
    without a path of the caller's goes when the session's JVM ends, if not before."""
    spark = frame.sparkSession
    target = path or new_path(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        # A frame takes the setting in when it is made; this one is made anew around the same plan.
        frame.select("*").write.mode("overwrite").option("compression", "zstd").parquet(target)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    if path is None:
        temporary(spark, target)
    return spark.read.schema(frame.schema).parquet(target)


def temporary(spark: SparkSession, path: str) -> None:
    """A folder that goes when the session's JVM ends, if not before."""
    fs, p = _at(spark, path)
    fs.deleteOnExit(p)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete shared folders through Hadoop's file system, wherever they are."""
    for path in paths:
        fs, p = _at(spark, path)
        fs.delete(p, True)


def discard(*frames: DataFrame) -> None:
    """Delete the tables that materialize() returned, once nothing reads them any more."""
    for frame in frames:
        for folder in {name.rpartition("/")[0] for name in frame.inputFiles()[:1]}:
            remove(frame.sparkSession, folder)

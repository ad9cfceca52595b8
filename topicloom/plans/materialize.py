"""Cutting lineage and keeping intermediate tables, in ways that survive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_made: set[str] = set()
#: Spark's setting by which a query's shuffled files are deleted when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir). Where none is set, a local session gets one of its own; on a
    cluster, whose machines don't share their disks, that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="topicloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _files(spark: SparkSession, path: str):
    """(file system, path) in the JVM."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def written(df: DataFrame, drop_shuffles: bool = False) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read again: a short plan, safe if executors are lost.

    What an application wrote is deleted when it ends, or before by `discarded`. With `drop_shuffles` the files that were shuffled
    for it are deleted as soon as it is written, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/topicloom-{spark.sparkContext.applicationId}"
    if root not in _made:
        files, path = _files(spark, root)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _made.add(root)
    path = f"{root}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    if drop_shuffles:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if drop_shuffles:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Deletes the table behind a result of `written` that nothing will read again."""
    names = df.inputFiles()
    if names:
        files, path = _files(df.sparkSession, names[0].rsplit("/", 1)[0])
        files.delete(path, True)


def kept(df: DataFrame) -> DataFrame:
    """`df` for several passes: blocks that are lost with an executor are computed again from the lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)

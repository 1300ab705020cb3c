"""Folders for intermediate files that all executors see."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark deletes the shuffle files of a query at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder ``spark.checkpoint.dir``.

    Where it is unset a local master gets a temporary folder of its own; a cluster raises, since its executors would each
    write to a disk that the others do not see.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="ticklane-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
        root = f"file://{own}"
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; what is left there when the driver's Python ends in order is deleted."""
    path = f"{scratch_root(spark)}/ticklane/{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_leave)
    _made.append((spark, path))
    return path


def written(df: DataFrame, label: str, records: int = 0) -> DataFrame:
    """df, written to a fresh path and read again: made once, whatever reads it.

    The shuffle files behind it are deleted as soon as it is written; nothing reads them again.  records: most rows of a file (0: any
    number), for rows that stand for many, so that many tasks read them.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, label), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("maxRecordsPerFile", records).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in any store that Spark writes."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _leave() -> None:
    for spark, path in _made:
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone; files stay as after a crash
            return

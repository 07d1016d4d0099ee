"""Materialisation points in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: Spark removes a command's shuffle files when it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    A local folder is made only where the setting is absent and Spark runs in one process (tests); on a cluster a
    missing setting is an error, since executors don't see each other's disks.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = getattr(spark, "_sextant_shared", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="sextant-")
        spark._sextant_shared = own
    return own


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/sextant-{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def expire(spark: SparkSession, hours: float = 24.0) -> list[str]:
    """Deletes the intermediates of runs that ended: those in the shared folder that are older than ``hours``.

    A result is lazy and reads its intermediates until it is written, so they can't go by themselves; call this between runs.
    """
    import time

    top = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    before, gone = (time.time() - 3600 * hours) * 1000, []
    for status in files.listStatus(top) if files.exists(top) else []:
        if status.getPath().getName().startswith("sextant-") and status.getModificationTime() < before:
            files.delete(status.getPath(), True)
            gone.append(status.getPath().getName())
    return gone


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later stages restart from the files.

    The shuffle files of the write go with its end, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._sextant_path = path
    return out


def once(spark: SparkSession, what: str, inputs: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """``materialise`` of what several queries of a session read: written again when an input file has changed, or the copy is gone.

    ``inputs`` are the paths that ``make`` reads; their files' names, sizes and times are the copy's key.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files, conf = [], spark._jsc.hadoopConfiguration()
    for path in inputs:
        top = hadoop(path)
        listed = top.getFileSystem(conf).listFiles(top, True)
        while listed.hasNext():
            f = listed.next()
            files.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    known = getattr(spark, "_sextant_once", None)
    if known is None:
        known = spark._sextant_once = {}
    key, held = (what, *sorted(files)), known.get((what, *sorted(files)))
    if held is not None and (at := hadoop(held._sextant_path)).getFileSystem(conf).exists(at):
        return held
    known[key] = materialise(make(), what)
    return known[key]


def release(df: DataFrame) -> None:
    """Removes what ``materialise`` wrote for ``df``; for steps whose result has been written itself."""
    if path := getattr(df, "_sextant_path", None):
        remove(df.sparkSession, path)

"""Session defaults and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, **conf: object) -> SparkSession:
    builder = SparkSession.builder.appName("weekcast")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder; on a cluster its executors couldn't
    share one, so the setting is asked for.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="weekcast-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/weekcast/{name}-{uuid.uuid4().hex}"


#: Files of a staged table for each core, and shuffle partitions that make a file where that gives more files.
FILES_PER_CORE, PARTITIONS_PER_FILE = 4, 8

#: Folders that ``stage`` has written in this process and that are still there.
_STAGED: list[str] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and go on from the files.

    For tables that several results read: lineage ends here, a lost executor loses nothing, and
    readers prune columns and filter as with any Parquet table. Several partitions go to one file, one after the
    other, for each file of a local folder costs an executor several child processes that set its permissions, and
    while one starts, samples count the executor's memory twice.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    _STAGED.append(path)
    files = max(FILES_PER_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // PARTITIONS_PER_FILE)
    df.coalesce(files).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes what is staged inside when it ends, but for tables staged with the function that it gives."""
    mark, kept = len(_STAGED), []

    def keep(df: DataFrame, name: str) -> DataFrame:
        staged = stage(df, name)
        kept.append(_STAGED[-1])
        return staged

    yield keep
    _delete(spark, [p for p in _STAGED[mark:] if p not in kept])
    _STAGED[mark:] = kept


def release_staged(spark: SparkSession) -> int:
    """Delete all tables that ``stage`` has written in this process; call it when nothing that reads them is needed.

    Returns how many there were. Published tables and those of other processes aren't touched.
    """
    released = len(_STAGED)
    _delete(spark, _STAGED)
    _STAGED.clear()
    return released

"""Scratch tables in the cluster's shared folder.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``: Spark's commit
protocol makes a table whole or absent, and every executor can read it again
after others are lost.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one where unset in a local session, as in tests.

    This application's tables there are deleted when the driver ends.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="corvane-"))
        path = _own[0]
    folder = f"{path}/corvane-{spark.sparkContext.applicationId}"
    if folder not in _own:
        _own.append(folder)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return folder


def table(df: DataFrame, label: str = "t", by: str | None = None) -> DataFrame:
    """Write ``df`` as a scratch table and return it as read back.

    by: a column to partition the files by, so that a later filter on it reads
    only its own files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    writer = df.write
    if by:
        writer = writer.partitionBy(by)
    writer.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> list[str]:
    """The tables written so far that have not been deleted."""
    return list(_made)


def unread(df: DataFrame, tables: list[str]) -> list[str]:
    """Those of the tables that ``df`` does not read."""
    if not tables:
        return []
    folders = {part for f in df.inputFiles() for part in f.split("/")}
    return [t for t in tables if t.rsplit("/", 1)[-1] not in folders]


def delete(spark: SparkSession, tables: list[str]) -> None:
    """Delete tables once nothing reads them."""
    for table_ in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table_)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if table_ in _made:
            _made.remove(table_)


def drop(df: DataFrame) -> None:
    """Delete the scratch tables that ``df`` reads, once what is made of it has been written."""
    kept = set(unread(df, _made))
    delete(df.sparkSession, [t for t in _made if t not in kept])


def free(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished jobs, which it does once the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_all(spark: SparkSession) -> None:
    """Delete every scratch table of this application."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

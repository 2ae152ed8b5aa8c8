"""A folder that the driver and all executors reach, and the few file operations that tables of state need."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, deleted when the driver ends; a temporary one where that is unset in a local session."""
    app = spark.sparkContext.applicationId
    if app not in _made:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="corvane-")
        _made[app] = f"{root}/corvane-tables-{app}"
        files(spark, _made[app]).deleteOnExit(at(spark, _made[app]))
    return _made[app]


def at(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def files(spark: SparkSession, path: str):
    return at(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def table(df: DataFrame, label: str, **options) -> DataFrame:
    """``df`` written below ``folder`` and read back: its lineage is cut, and lost executors cost nothing. options: the writer's."""
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is none."""
    fs = files(spark, path)
    if not fs.exists(at(spark, path)):
        return None
    stream = fs.open(at(spark, path))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside ``path`` and take its place, so that a reader finds the old text or the new one.

    Where a store's rename does not replace, the old text stands aside as ``path``.old in between,
    and ``read_state`` finds it.
    """
    fs, new, old = files(spark, path), at(spark, path + ".new"), at(spark, path + ".old")
    stream = fs.create(new, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    if fs.exists(at(spark, path)):
        fs.delete(old, False)
        if not fs.rename(at(spark, path), old):
            raise OSError(f"{path} could not be put aside")
    if not fs.rename(new, at(spark, path)):
        fs.rename(old, at(spark, path))
        raise OSError(f"{path} could not be replaced")
    fs.delete(old, False)


def read_state(spark: SparkSession, path: str) -> str | None:
    """The text last written, also where a writer stopped between its two renames."""
    found = read_text(spark, path)
    return found if found is not None else read_text(spark, path + ".old")

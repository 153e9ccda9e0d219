"""Tables written between the steps of an iterative job.

Lineage is cut by writing Parquet into the folder that the cluster names in ``spark.checkpoint.dir``; every
executor can read it again, so a lost executor costs a re-read and nothing else.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a local one only in a session of one machine that names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="weft-")
    return _OWN[app]


class Scratch:
    """Names tables below one folder of the work dir and drops those that a later step has replaced."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{work_dir(spark)}/weft/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        path = self.write_path(df, partition_by)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_path(self, df: DataFrame, partition_by: list[str] | None = None) -> str:
        self._n += 1
        path = f"{self.root}/{self._n:04d}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return path

    def drop(self, df: DataFrame) -> None:
        """Remove the files behind a table made by write()."""
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if self.root.split("://")[-1] in folder:
                delete(self.spark, folder)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None if there is none."""
    target, fs = _file(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, in whole or not at all: it is renamed into place."""
    draft, fs = _file(spark, f"{path}.{uuid.uuid4().hex[:8]}")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    target = _file(spark, path)[0]
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(draft, target):
        raise OSError(f"can't write {path}")

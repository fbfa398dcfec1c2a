"""Shared scratch tables: how iterative operators cut their lineage.

A scratch table is a Parquet folder below ``spark.checkpoint.dir``, which every
executor and the driver can reach, so a lost executor costs a re-read and not a
re-run.  Only where the session names no such folder (unit tests, local mode) a
temporary folder of this machine is used instead.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch: texts may be long.
ARROW_ROWS = 512
_local_root: str | None = None


def root(spark: SparkSession) -> str:
    """The shared folder for scratch tables of this session."""
    global _local_root
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="tidegraph-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return f"file://{_local_root}"


def path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it goes when the session ends."""
    where = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(where)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return where


#: While a scratch table is written: its shuffle files go as soon as it stands, and Python gets modest batches.
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    return append(df, path(df.sparkSession, name), partition_by)


def append(df: DataFrame, where: str, partition_by: str | None = None) -> DataFrame:
    """Add ``df`` to the table at ``where`` and return the whole table read back."""
    spark = df.sparkSession
    out = df.write.mode("append").option("compression", "zstd")
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        (out.partitionBy(partition_by) if partition_by else out).parquet(where)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(where)


def _at(spark: SparkSession, where: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, where: str) -> bool:
    files, at = _at(spark, where)
    return files.exists(at)


def remove(spark: SparkSession, where: str) -> None:
    """Delete a folder below the shared one that nothing reads any more."""
    files, at = _at(spark, where)
    files.delete(at, True)


def replace(df: DataFrame, name: str, *old: DataFrame) -> DataFrame:
    """``materialize(df, name)``, after which the materialized tables that it was made from go."""
    out = materialize(df, name)
    for table in old:
        drop(table)
    return out


def drop(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        folder = name.rsplit("/", 1)[0]
        if not folder.startswith(root(spark).replace("file://", "file:")) and not folder.startswith(root(spark)):
            return
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and get their rows in modest batches."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in parts:
        env["PYTHONPATH"] = os.pathsep.join([here, *parts])

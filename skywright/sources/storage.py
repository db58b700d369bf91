"""The folder that driver and executors share, and files written and read through Hadoop's file systems."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as Hadoop's."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def glob_count(spark: SparkSession, pattern: str) -> int:
    fs, p = file_system(spark, pattern)
    return len(fs.globStatus(p) or [])


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, one of our own on a single machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "skywright-checkpoints")


_OWNED: set[str] = set()


def run_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared one; Hadoop's file system deletes it when the driver ends."""
    path = f"{shared_dir(spark)}/skywright/{spark.sparkContext.applicationId}"
    if path not in _OWNED:
        _OWNED.add(path)
        fs, p = file_system(spark, path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and a lost executor costs no recomputation."""
    path = f"{run_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

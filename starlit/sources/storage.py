"""Paths in whatever file system Spark can reach (local, hdfs://, s3a://, file:// ...)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _open(spark, path)
    return fs.exists(jpath)


def list_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, in name order; none when the folder is missing."""
    fs, jpath = _open(spark, pattern)
    return sorted(str(s.getPath().toString()) for s in (fs.globStatus(jpath) or []))

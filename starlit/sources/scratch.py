"""Intermediate tables in the session's shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from starlit.session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written once to shared storage and read back: its lineage is cut, a lost executor costs a re-read,
    and what Spark drew while writing (row numbers, range bounds) stays as it was. Deleted when the application ends."""
    spark = df.sparkSession
    path = f"{scratch_path(spark, name)}/{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

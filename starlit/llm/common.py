"""Shared helpers of the training-data operators: table access and shared-storage scratch tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from starlit.session import ensure_checkpoint_dir

# Fixed values of the text contracts: the six white-space characters \x20 \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
WORD_CLASS = "[^\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the session's shared checkpoint folder, deleted when the application ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/starlit-llm/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def stash(df: DataFrame, name: str, fmt: str = "parquet") -> DataFrame:
    """Write an intermediate table once to shared storage and read it back: cuts lineage, and a lost
    executor costs only a re-read."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.format(fmt).save(path)
    return spark.read.format(fmt).schema(df.schema).load(path)


@contextmanager
def session_conf(spark: SparkSession, want: dict[str, str]) -> Iterator[None]:
    """Settings for what runs inside; the session's own come back after it. Only for plans that run inside, not for lazy
    ones that are returned."""
    before = {k: spark.conf.get(k, None) for k in want}
    try:
        for k, v in want.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def arrow_batches(spark: SparkSession, rows: int, size: int):
    """Arrow batches of at most so many rows and about so many bytes for what runs inside (see ``session_conf``)."""
    return session_conf(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows),
                                "spark.sql.execution.arrow.maxBytesPerBatch": str(size)})


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure-ASCII texts take the fast built-in; others map the 26 letters."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def word_count(text: Column) -> Column:
    """Number of white-space separated words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def add_missing(df: DataFrame, **columns: str) -> DataFrame:
    """Columns a caller's table may lack, as typed nulls."""
    have = set(df.columns)
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in have})

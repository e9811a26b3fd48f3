"""Table-level sources and sinks: column resolution, Parquet/CSV/JSON writers, extract discovery."""

from __future__ import annotations

import logging
import os

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starlit.functions.expr import as_double
from starlit.sources.columns import OBSERVED, resolve_observed
from starlit.sources.storage import list_paths

log = logging.getLogger(__name__)

CANONICAL_ORDER = ("object_id", "quarter", "time")


def to_observations(df: DataFrame) -> DataFrame:
    """Map a light-curve table with instrument column names (any case) onto the observation columns.

    TIME and a flux column are required; flux_err falls back to NULL and quality to 0. Bad text and NaN are NULL.
    """
    found = resolve_observed(df.columns, "table")
    types = {f.name: f.dataType for f in df.schema.fields}
    keep = [c for c in ("dataset", "source_file", "object_id", "quarter") if c in df.columns]
    return df.select(*keep, *[
        (as_double(column, types[column]) if column else F.lit(OBSERVED[name].absent).cast("double")).alias(name)
        for name, column in found.items()])


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", partition_by=None,
                  mode: str = "overwrite") -> None:
    """Distributed Parquet sink; codec one of snappy, gzip, brotli, zstd, lz4, none."""
    codec = "none" if compression in (None, "none") else compression
    w = df.write.mode(mode).option("compression", codec)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", partition_by: str | None = None, mark: bool = True) -> None:
    """CSV with a header row; with ``mark`` every file starts with the UTF-8 byte-order mark (spreadsheet programs
    read the text as UTF-8 then, and Spark's reader drops it)."""
    if mark:
        first = next(c for c in df.columns if c != partition_by)
        df = df.withColumnRenamed(first, f"\ufeff{first}")
    w = df.write.mode(mode).option("header", True).option("encoding", "UTF-8")
    (w.partitionBy(partition_by) if partition_by else w).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def preview_head(df: DataFrame, n: int = 5000, order=CANONICAL_ORDER) -> DataFrame:
    """First n rows in canonical order (a top-n: each task keeps at most n rows)."""
    return df.orderBy(*order).limit(n)


def preview_by(df: DataFrame, key: str, n: int = 5000, order=CANONICAL_ORDER) -> DataFrame:
    """``preview_head`` of every key in one job: tasks keep n rows of a key before the shuffle (a group limit), so
    no task sees a whole key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).orderBy(key, "_rank").drop("_rank")


def discover_extracts(spark: SparkSession, directory: str, suffix: str = "_dash_data.parquet",
                      skipped: list | None = None) -> DataFrame | None:
    """All ``<key>_dash_data.parquet`` extracts of a folder in one read; key taken from the file name.

    Extracts whose footers can't be read are left out and reported: (path, error) is appended to ``skipped``
    and logged. An extract that turns out broken later fails the job. None when there is no readable extract.

    Footers are read by tasks, those of all extracts in one job. Only if that fails are the extracts halved, so a
    broken one among n costs some log n jobs and none is looked at by itself without cause."""
    paths = [p for p in list_paths(spark, os.path.join(directory, f"*{suffix}"))]
    found = _readable(spark, paths, [] if skipped is None else skipped)
    if not found:
        return None
    df = spark.read.option("mergeSchema", "true").parquet(*found)
    name = F.col("_metadata.file_path")
    key = F.regexp_extract(name, r"([^/]+)" + suffix.replace(".", r"\.") + r"(/[^/]*)?$", 1)
    return df.withColumn("dataset_key", key).withColumn("object_id", F.col("object_id").cast("string"))


def _readable(spark: SparkSession, paths: list[str], skipped: list) -> list[str]:
    """The paths whose Parquet footers can be read, in order; the others go to ``skipped`` with the reason."""
    if not paths:
        return []
    try:
        spark.read.option("mergeSchema", "true").parquet(*paths)  # a job over footers, no data
        return paths
    except (PySparkException, Py4JJavaError) as exc:
        if "FOOTER" not in str(exc) and "UNABLE_TO_INFER_SCHEMA" not in str(exc):
            raise  # storage trouble, not a file that is no table
        if len(paths) == 1:
            log.warning("extract %s skipped: %s", paths[0], exc)
            skipped.append((paths[0], str(exc)))
            return []
    half = len(paths) // 2
    return _readable(spark, paths[:half], skipped) + _readable(spark, paths[half:], skipped)

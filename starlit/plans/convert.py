"""Light-curve conversion job: files -> prepared observations Parquet + preview + summary."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlit.operators.positions import in_order
from starlit.plans.lightcurve import prepare_by_dataset
from starlit.session import scratch_path
from starlit.sources import fits, tables


def conversion_summary(spark: SparkSession, parsed: DataFrame, files: DataFrame | None,
                       datasets: list[str], prepared: DataFrame | None = None) -> DataFrame:
    """Per dataset: files, rows, objects, quarters, anomaly rows and status
    (no_files / failed / success / success_with_errors)."""
    inv = fits.file_inventory(spark, files, datasets).select("dataset", "fits_files")
    errs = parsed.groupBy("dataset").agg(F.count(F.col("error")).alias("errors"),
                                         F.count(F.when(F.col("error").isNull(), F.col("source_file"))).alias("_ok"))
    if prepared is None:
        prepared = prepare_by_dataset(fits.good_rows(parsed))
    stats = prepared.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("object_id").alias("objects"),
        F.count_distinct("quarter").alias("quarters"), F.sum(F.col("is_anomaly").cast("long")).alias("anomaly_rows"))
    out = inv.join(errs, "dataset", "left").join(stats, "dataset", "left")
    files_n, errors = F.col("fits_files"), F.coalesce(F.col("errors"), F.lit(0))
    good = F.coalesce(F.col("_ok"), F.lit(0)) > 0
    status = (F.when(files_n == 0, F.lit("no_files")).when(~good, F.lit("failed"))
              .when(errors > 0, F.lit("success_with_errors")).otherwise(F.lit("success")))
    return out.select(
        "dataset", "fits_files",
        *[F.when(good, F.coalesce(F.col(c), F.lit(0))).otherwise(F.lit(0)).cast("long").alias(c)
          for c in ("rows", "objects", "quarters", "anomaly_rows")],
        F.lit("").alias("output_file"), F.lit(0.0).alias("size_mb"), status.alias("status"))


def written_sizes(spark: SparkSession, data_path: str) -> DataFrame:
    """Per dataset partition: output folder and size in MB of the written Parquet files
    (file lengths from the listing; no file content is read)."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
             .option("recursiveFileLookup", "true").load(data_path).select("path", "length"))
    ds = F.regexp_extract("path", r"dataset=([^/]+)/", 1)
    return files.groupBy(ds.alias("dataset")).agg(
        F.round(F.sum("length") / F.lit(1024.0 * 1024.0), 3).alias("size_mb")) \
        .withColumn("output_file", F.concat(F.lit(data_path.rstrip("/") + "/dataset="), F.col("dataset")))


def convert(spark: SparkSession, raw_dirs: dict[str, str], out_dir: str, compression: str = "snappy",
            preview_rows: int = 5000) -> DataFrame:
    """Ingest every dataset folder, write prepared Parquet (partitioned by dataset, in canonical order) and, per
    dataset, a sorted preview CSV and its conversion errors if there are any; return the summary.

    Files are decoded once, into a table on shared storage partitioned by dataset; everything after reads that. All
    datasets go through the same jobs, so the number of jobs doesn't follow theirs."""
    datasets = list(raw_dirs)
    files = fits.list_files(spark, raw_dirs, with_content=False)
    staged = scratch_path(spark, f"decoded/{uuid.uuid4().hex}")
    fits.read_light_curves(spark, raw_dirs).write.partitionBy("dataset").parquet(staged)
    parsed = spark.read.schema(fits.INGEST_SCHEMA).parquet(staged)
    good, bad = fits.good_rows(parsed), fits.error_rows(parsed)
    if good.isEmpty():
        return conversion_summary(spark, parsed, files, datasets)
    data_path = os.path.join(out_dir, "observations")
    prepared = in_order(prepare_by_dataset(good), ["dataset", *tables.CANONICAL_ORDER])
    tables.write_parquet(prepared, data_path, compression, partition_by="dataset")
    written = spark.read.parquet(data_path)
    previews = tables.preview_by(written, "dataset", preview_rows)
    tables.write_csv(previews, os.path.join(out_dir, "preview"), partition_by="dataset")
    if not bad.isEmpty():
        tables.write_csv(bad, os.path.join(out_dir, "conversion_errors"), partition_by="dataset")
    summary = conversion_summary(spark, parsed, files, datasets, written).drop("size_mb", "output_file")
    sizes = written_sizes(spark, data_path)
    return summary.join(sizes, "dataset", "left").select(
        "dataset", "fits_files", "rows", "objects", "quarters", "anomaly_rows",
        F.coalesce("output_file", F.lit("")).alias("output_file"),
        F.coalesce("size_mb", F.lit(0.0)).alias("size_mb"), "status")

"""Views of the shared test tables in the light-curve data model.

The engine's own inputs (light-curve files, observation Parquet, run logs) are
not shipped with the test data, so these adapters derive them from the given
tables with plain column expressions; every query that uses them scales with
those tables.  The DuckDB twins live in ``starlit.plans.oracle``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlit.functions.expr import round_scaled

# Fixed values of the adapters (must match the oracle SQL):
#   epoch 2024-01-01 00:00:00 (1704067200000000 microseconds), 86400000000 microseconds per day,
#   10-day quarters numbered from 1, dataset names small / medium / large by user_id % 3,
#   NULL time when event_id % 101 = 0, NULL flux when event_id % 97 = 0,
#   NULL flux_err for 'click' events (else value * 0.01),
#   NULL quality when event_id % 89 = 0, quality 1.0 for 'error' events, else 0.0.
EPOCH_NTZ = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"
MICROS_PER_DAY = 86400000000.0
DATASET_NAMES = ["small", "medium", "large"]


# Declared schemas of the shared tables the adapters read (no footer inference at plan time).
TABLE_SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                 "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                 "l_linestatus string, l_shipdate timestamp_ntz"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in TABLE_SCHEMAS:
        reader = reader.schema(TABLE_SCHEMAS[name])
    return reader.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def days_since_epoch(ts_col: str = "ts"):
    # timestampdiff on TIMESTAMP_NTZ does not depend on the session time zone.
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH_NTZ}, {ts_col})") / F.lit(MICROS_PER_DAY)


DAYS_SQL = f"(timestampdiff(MICROSECOND, {EPOCH_NTZ}, ts) / {MICROS_PER_DAY!r}D)"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``obs``: events as light-curve observations with nulls injected by event_id."""
    ev = table(spark, sf_dir, "events")
    t = DAYS_SQL
    names = ", ".join(f"'{n}'" for n in DATASET_NAMES)
    return ev.selectExpr(
        f"element_at(array({names}), CAST(user_id % 3 AS INT) + 1) AS dataset",
        "event_type AS source_file",
        "CAST(user_id AS STRING) AS object_id",
        f"CAST(FLOOR({t} / 10) + 1 AS INT) AS quarter",
        f"CASE WHEN event_id % 101 != 0 THEN {t} END AS time",
        "CASE WHEN event_id % 97 != 0 THEN value END AS flux",
        "CASE WHEN event_type != 'click' THEN value * 0.01D END AS flux_err",
        "CASE WHEN event_id % 89 = 0 THEN CAST(NULL AS DOUBLE) WHEN event_type = 'error' THEN 1.0D "
        "ELSE 0.0D END AS quality",
    )


def observations_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``obs_raw``: obs with numeric columns as text and 'n/a' for missing flux."""
    obs = observations(spark, sf_dir)
    return obs.select(
        "dataset", "source_file", "object_id", "quarter",
        F.col("time").cast("string").alias("time"),
        F.coalesce(F.col("flux").cast("string"), F.lit("n/a")).alias("flux"),
        F.col("flux_err").cast("string").alias("flux_err"),
        F.col("quality").cast("string").alias("quality"),
    )


def ephemeris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ephemeris row per object: period 1.5 + id % 20, duration 0.01 + (id % 6) * 0.01,
    depth 0.001 * (1 + id % 20), base flux 50.0."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    uid = F.col("user_id")
    return users.select(
        uid.cast("string").alias("object_id"),
        F.lit(50.0).alias("base_flux"),
        (F.lit(1.5) + (uid % 20).cast("double")).alias("period"),
        (F.lit(0.001) * (F.lit(1.0) + (uid % 20).cast("double"))).alias("depth"),
        (F.lit(0.01) + (uid % 6).cast("double") * F.lit(0.01)).alias("duration"),
    )


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run_metrics``: lineitem rows as processing x visualisation run records."""
    li = table(spark, sf_dir, "lineitem")
    proc = F.col("l_extendedprice") / F.lit(100000.0)
    viz = F.col("l_discount")
    return li.select(
        F.col("l_returnflag").alias("dataset"),
        F.concat(F.lit("m"), F.col("l_linenumber").cast("string"), F.lit(" + "),
                 F.lower(F.col("l_linestatus"))).alias("pair"),
        proc.alias("processing_time_sec"),
        viz.alias("visualization_time_sec"),
        round_scaled(proc + viz, 6).alias("total_time_sec"),
        F.col("l_quantity").alias("processing_memory_peak_mb"),
        F.when(F.col("l_tax") >= 0.07, F.lit("ERROR")).otherwise(F.lit("Success")).alias("status"),
    )

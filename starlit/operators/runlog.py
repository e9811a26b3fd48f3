"""Run logs: reading, cleaning, combining and assembling processing x visualisation records."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starlit.functions.expr import as_double, round_scaled, sql_as_double, with_split_pair, with_sql
from starlit.schema import RUN_METRICS, RUN_METRICS_REQUIRED, require_columns
from starlit.sources.storage import path_exists

log = logging.getLogger(__name__)

METRIC_NUMBERS = ["processing_time_sec", "visualization_time_sec", "total_time_sec",
                  "processing_memory_peak_mb"]

# Fixed display order of known datasets / methods; anything else sorts last (99).
DATASET_ORDER = {"small": 0, "medium": 1, "large": 2}
METHOD_ORDER = {"pandas": 0, "dask": 1, "spark": 2}
VIZ_ORDER = {"matplotlib": 0, "plotly": 1, "dash": 2}


def read_run_metrics_csv(spark, path: str) -> DataFrame:
    """CSV run log (header row; a UTF-8 byte-order mark is stripped by the reader)."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    require_columns(df.columns, RUN_METRICS_REQUIRED, "metrics file")
    return df


def read_run_log_if_exists(spark, path: str, skipped: list | None = None) -> DataFrame | None:
    """A run log to combine, or None when the file is missing, empty or not a table; the reason is logged and
    (path, reason) appended to ``skipped``. Storage and job errors are not taken for a missing log."""
    try:
        if not path_exists(spark, path):
            raise ValueError("no such file")
        df = spark.read.option("header", True).csv(path)
        df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
        if df.isEmpty():
            raise ValueError("no rows")
        return df
    except (AnalysisException, ValueError) as exc:
        log.warning("run log %s skipped: %s", path, exc)
        if skipped is not None:
            skipped.append((path, str(exc)))
        return None


def with_methods(df: DataFrame) -> DataFrame:
    """Numeric coercion, methods split from the pair text (overwriting any given), lower-case
    dataset and status."""
    require_columns(df.columns, RUN_METRICS_REQUIRED, "metrics")
    types = {f.name: f.dataType for f in df.schema.fields}
    df = with_sql(df, {
        **{c: sql_as_double(c, types[c]) for c in METRIC_NUMBERS},
        "dataset": "lower(CAST(dataset AS STRING))",
        "status": "lower(CAST(status AS STRING))",
    })
    return with_split_pair(df, "pair", "processing_method", "visualization_method")


def successful_runs(df: DataFrame) -> DataFrame:
    return df.filter((F.lower(F.col("status")) == "success") & F.col("total_time_sec").isNotNull())


def order_key(col: str, mapping: dict[str, int]):
    expr = F.lit(99)
    for name, rank in mapping.items():
        expr = F.when(F.col(col) == name, F.lit(rank)).otherwise(expr)
    return expr


def with_order(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "dataset_order": order_key("dataset", DATASET_ORDER),
        "method_order": order_key("processing_method", METHOD_ORDER),
        "viz_order": order_key("visualization_method", VIZ_ORDER),
    })


def clean_run_log(df: DataFrame, sort: bool = False) -> DataFrame:
    """The analysable run log: successful rows with a total time, methods split out."""
    out = successful_runs(with_methods(df))
    return in_display_order(out) if sort else out


def in_display_order(df: DataFrame) -> DataFrame:
    order = ["dataset_order", "method_order", "viz_order"]
    return with_order(df).orderBy(*order).drop(*order)


def combine_run_logs(logs: list[DataFrame | None]) -> DataFrame | None:
    """Union of run logs by column name; columns missing from a log are NULL; empty inputs skipped (None when
    nothing is left). Where logs disagree on a column's type, metrics become numbers (bad text is NULL) and
    everything else text."""
    logs = [d for d in logs if d is not None]
    if not logs:
        return None
    types: dict[str, set] = {}
    for d in logs:
        for f in d.schema.fields:
            types.setdefault(f.name, set()).add(f.dataType)
    numbers = {f.name for f in RUN_METRICS.fields if isinstance(f.dataType, T.NumericType)}

    def agreed(d: DataFrame) -> DataFrame:
        return d.withColumns({
            f.name: as_double(f.name, f.dataType) if f.name in numbers else F.col(f.name).cast("string")
            for f in d.schema.fields if len(types[f.name]) > 1})
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(agreed, logs))


# What the processing summary and the chart metadata add to a run record.
PROCESSED_FACTS = ["input_file", "output_file", "rows_input", "rows_after_cleaning", "rows_output", "objects", "quarters", "anomaly_rows"]
CHART_FACTS = ["visualization_file", "visualization_metadata_file", "visualization_type", "points_plotted",
               "anomaly_points_plotted", "rows_before_downsample"]


def _with_facts(df: DataFrame, facts: list[str]) -> DataFrame:
    """``df`` with the given run-log columns it lacks, as typed nulls."""
    types = {f.name: f.dataType for f in RUN_METRICS.fields}
    return df.withColumns({c: F.lit(None).cast(types[c]) for c in facts if c not in df.columns})


def assemble_run_log(processing: DataFrame, visualization: DataFrame, charts: DataFrame | None = None) -> DataFrame:
    """Processing records x their visualisation records x what was plotted: all columns of ``RUN_METRICS``, in order.

    processing: dataset, processing_method, input_exists, processing_time_sec, processing_memory_peak_mb, status,
                error, and any of PROCESSED_FACTS (as ``plans.jobs.process_file`` returns them)
    visualization: dataset, processing_method, visualization_method,
                   visualization_time_sec, visualization_memory_peak_mb, status, error
    charts: dataset, processing_method, visualization_method and any of CHART_FACTS (``extract.chart_metadata``)
    A successful processing run yields one row per visualisation with
    total = round(processing + visualisation, 6), the visualisation's status and the facts of both;
    a failed one yields a single row with total = processing time; a missing input
    yields a row with the error text only. A visualisation without chart metadata has no chart facts. Facts of runs
    that failed are left out.
    """
    keys = ["dataset", "processing_method", "visualization_method"]
    if charts is not None:
        visualization = visualization.join(_with_facts(charts, CHART_FACTS).select(*keys, *CHART_FACTS), keys, "left")
    p = _with_facts(processing, PROCESSED_FACTS).alias("p")
    v = _with_facts(visualization, CHART_FACTS).alias("v")
    ok = F.col("p.input_exists") & (F.col("p.status") == "success")
    joined = p.join(v, (F.col("p.dataset") == F.col("v.dataset"))
                    & (F.col("p.processing_method") == F.col("v.processing_method")) & ok, "left")
    missing = ~F.col("p.input_exists")
    viz_name = F.when(ok & F.col("v.visualization_method").isNotNull(), F.col("v.visualization_method")) \
        .otherwise(F.lit(""))
    proc_time = F.when(missing, F.lit(None).cast("double")).otherwise(F.col("p.processing_time_sec"))
    drawn = ok & (F.col("v.status") == "success")
    columns = {
        "dataset": F.col("p.dataset"),
        "processing_method": F.col("p.processing_method"),
        "visualization_method": viz_name,
        "pair": F.concat(F.col("p.processing_method"), F.lit(" +"),
                         F.when(viz_name != "", F.concat(F.lit(" "), viz_name)).otherwise(F.lit(""))),
        "processing_time_sec": proc_time,
        "processing_memory_peak_mb": F.when(missing, F.lit(None).cast("double")).otherwise(F.col("p.processing_memory_peak_mb")),
        "visualization_time_sec": F.col("v.visualization_time_sec"),
        "visualization_memory_peak_mb": F.col("v.visualization_memory_peak_mb"),
        "total_time_sec": F.when(ok, round_scaled(F.col("p.processing_time_sec") + F.col("v.visualization_time_sec"), 6)).otherwise(proc_time),
        "status": F.when(drawn, F.lit("success")).otherwise(F.lit("error")),
        "error": F.when(ok, F.col("v.error")).otherwise(F.col("p.error")),
        **{c: F.when(ok, F.col(f"p.{c}")) for c in PROCESSED_FACTS},
        **{c: F.when(drawn, F.col(f"v.{c}")) for c in CHART_FACTS},
    }
    return joined.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in RUN_METRICS.fields])

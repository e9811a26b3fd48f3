"""End-to-end jobs: process an observation table, build extracts, analyse a run log.

Each job reads with Spark, runs one lazy plan per output and writes with Spark's
distributed writers; only small summary rows come back to the caller.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from starlit.operators import analysis, extract, runlog
from starlit.plans import lightcurve
from starlit.schema import DASH_MAX_POINTS, DASH_MIN_PER_OBJECT, REQUIRED_PIPELINE_COLUMNS, Params, require_columns
from starlit.sources import tables
from starlit.sources.scratch import written


def read_input(spark: SparkSession, path: str) -> DataFrame:
    """Parquet input; a missing path raises FileNotFoundError (not a deferred analysis error)."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            raise FileNotFoundError(f"Input file not found: {path}") from exc
        raise


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Raise when a table has no rows (a one-row probe, not a count)."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def process_file(spark: SparkSession, input_path: str, output_dir: str, dataset: str, mode: str = "bin",
                 params: Params = Params(), method: str = "spark") -> dict:
    """Read observations, run the pipeline, write ``<dataset>_<method>_processed`` and return the summary."""
    raw = read_input(spark, input_path)
    require_columns(raw.columns, REQUIRED_PIPELINE_COLUMNS)
    # the input row count is observed by the first job that scans the input (the profile pass)
    counted, seen = lightcurve.observed_counts(raw, "rows_input")
    facts: dict = {}
    out = lightcurve.process(counted, dataset, mode, params, method, profile_out=facts)
    path = os.path.join(output_dir, f"{dataset}_{method}_processed.parquet")
    tables.write_parquet(out, path)
    output = require_rows(spark.read.parquet(path), "processed output")
    summary = lightcurve.output_summary(output, dataset, seen.get["rows"], facts["rows"])
    return {**summary, "input_file": input_path, "output_file": path}


def build_dashboard_extract(spark: SparkSession, processed_path: str, output_dir: str, dataset: str,
                            method: str, max_points: int = DASH_MAX_POINTS,
                            min_per_object: int = DASH_MIN_PER_OBJECT) -> dict:
    """Write ``<dataset>_<method>_dash_data.parquet`` (clustered for pruned reads), the table of its object ids and its
    one-row JSON metadata, which is returned."""
    processed = require_rows(read_input(spark, processed_path), f"Processed file {processed_path}")
    before = extract.extract_project(processed)
    out = os.path.join(output_dir, f"{dataset}_{method}_dash_data.parquet")
    ids = os.path.join(output_dir, f"{dataset}_{method}_dash_objects.json")
    extract.write_extract(extract.dashboard_extract(processed, max_points, min_per_object), out)
    saved = spark.read.parquet(out)
    tables.write_json(extract.extract_objects(saved), ids)
    meta = extract.extract_metadata(before, saved, dataset, method, processed_path, out, ids)
    tables.write_json(meta.coalesce(1), os.path.join(output_dir, f"{dataset}_{method}_dash_metadata.json"))
    return meta.first().asDict()


def analyze_run_log(spark: SparkSession, metrics_path: str, output_dir: str) -> dict[str, str]:
    """The analytics step: clean run log, six summary tables, report lines; each written as CSV. The log is scanned
    once, into a cleaned table; the summaries all come from its partial aggregates, written once as well."""
    clean = written(runlog.clean_run_log(runlog.read_run_metrics_csv(spark, metrics_path)), "clean-log")
    partials = written(analysis.run_partials(clean), "run-partials")
    outputs = {
        "all_pair_metrics_clean": runlog.in_display_order(clean),
        "best_pair_by_dataset": analysis.best_pair_by_dataset(partials),
        "best_pair_by_processing_method": analysis.best_pair_by_method(partials),
        "processing_method_summary": analysis.processing_summary(partials).orderBy("dataset", "mean_total_time_sec"),
        "visualization_method_summary": analysis.visualization_summary(partials)
        .orderBy("dataset", "mean_visualization_time_sec"),
        "pair_ranking": analysis.pair_ranking(partials).orderBy("rank"),
        "report_lines": analysis.format_report(analysis.report_lines(partials)).orderBy("section", "ord"),
    }
    paths = {}
    for name, df in outputs.items():
        paths[name] = os.path.join(output_dir, name)
        tables.write_csv(df.coalesce(1) if name != "all_pair_metrics_clean" else df, paths[name])
    return paths

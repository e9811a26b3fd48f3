"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator key.

Every query reads the shared test tables through ``starlit.sources.adapters``
and runs over the whole tables.  Float outputs are rounded to 6 digits so the
DuckDB twin in ``starlit.plans.oracle`` can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starlit.functions.expr import round_scaled
from starlit.plans import lightcurve
from starlit.schema import Params
from starlit.sources import adapters

# Bin width used by the registered queries (about 67 points per object over
# the 30 days of the test events); the engine default stays 0.05 days.
QUERY_PARAMS = Params(bin_width=0.5)
DATASET = "obs"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def round_floats(df: DataFrame, digits: int = 6, skip=()) -> DataFrame:
    from starlit.functions.expr import q, sql_round, with_sql
    cols = {f.name: sql_round(q(f.name), digits) for f in df.schema.fields
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in skip}
    return with_sql(df, cols) if cols else df


def obs(spark, sf_dir):
    return adapters.observations(spark, sf_dir)


@register("process_point")
def q_process_point(spark, sf_dir):
    out = lightcurve.process(obs(spark, sf_dir), DATASET, "point", QUERY_PARAMS)
    return round_floats(out, skip=("time_bin",))


@register("process_bin")
def q_process_bin(spark, sf_dir):
    out = lightcurve.process(obs(spark, sf_dir), DATASET, "bin", QUERY_PARAMS)
    return round_floats(out, skip=("time_bin",))


# --- scans, cleaning, projections -----------------------------------------------------------
from starlit.functions.expr import as_quarter, bin_id as bin_id_expr, bin_time  # noqa: E402
from starlit.operators import clean, normalize, trend  # noqa: E402
from starlit.operators.positions import positions  # noqa: E402
from starlit.operators.quantile import exact_quantile_value  # noqa: E402

P = QUERY_PARAMS


def cleaned(spark, sf_dir):
    return clean.clean_observations(obs(spark, sf_dir))


@register("scan_parquet")
def q_scan_parquet(spark, sf_dir):
    ev = adapters.table(spark, sf_dir, "events")
    return ev.filter(F.col("value") > 50.0).select("event_id", "user_id", "value")


@register("coerce_numeric")
def q_coerce_numeric(spark, sf_dir):
    raw = adapters.observations_raw(spark, sf_dir)
    return clean.coerce_numeric(raw).select("object_id", "quarter", "time", "flux", "flux_err", "quality")


@register("default_columns")
def q_default_columns(spark, sf_dir):
    bare = obs(spark, sf_dir).drop("flux_err", "quality", "quarter", "source_file")
    return clean.with_defaults(bare).select("object_id", "quarter", "source_file", "time", "flux",
                                            "flux_err", "quality")


@register("normalize_quarter")
def q_normalize_quarter(spark, sf_dir):
    # quarter text with gaps: NULL for view events, non-numeric for signups
    o = obs(spark, sf_dir)
    q = (F.when(F.col("source_file") == "view", F.lit(None).cast("string"))
         .when(F.col("source_file") == "signup", F.lit("q?"))
         .otherwise(F.col("quarter").cast("string")))
    return o.select("object_id", "time", as_quarter(q).alias("quarter"))


@register("drop_invalid")
def q_drop_invalid(spark, sf_dir):
    return clean.drop_invalid(obs(spark, sf_dir))


@register("fill_quality")
def q_fill_quality(spark, sf_dir):
    return clean.fill_quality(obs(spark, sf_dir))


@register("good_quality")
def q_good_quality(spark, sf_dir):
    return clean.good_quality(cleaned(spark, sf_dir))


@register("good_quality_fallback")
def q_good_quality_fallback(spark, sf_dir):
    # every flag bad (4) -> nothing passes -> the whole cleaned input is kept
    bad = obs(spark, sf_dir).withColumn("quality", F.lit(4.0))
    return clean.good_quality(clean.clean_observations(bad))


@register("fill_err_median")
def q_fill_err_median(spark, sf_dir):
    df = clean.drop_invalid(clean.coerce_numeric(obs(spark, sf_dir)), ("time", "flux"))
    return round_floats(clean.fill_flux_err(df, "median_or_zero"))


@register("fill_err_median_strict")
def q_fill_err_median_strict(spark, sf_dir):
    return round_floats(clean.fill_flux_err(clean.good_quality(cleaned(spark, sf_dir)), "median"))


@register("fill_err_mean")
def q_fill_err_mean(spark, sf_dir):
    return round_floats(clean.fill_flux_err(clean.good_quality(cleaned(spark, sf_dir)), "mean"))


@register("global_err_stats")
def q_global_err_stats(spark, sf_dir):
    good = clean.good_quality(cleaned(spark, sf_dir))
    # small buckets and finish size so the check walks several refinement rounds
    med = exact_quantile_value(good, "flux_err", 0.5, buckets=16, finish_limit=100)
    return round_floats(good.agg(F.avg("flux_err").alias("flux_err_mean"),
                                 F.count("flux_err").alias("flux_err_count"))
                        .withColumn("flux_err_median", F.lit(med).cast("double")))


def filled_points(spark, sf_dir, mode="point"):
    return lightcurve.cleaned_points(obs(spark, sf_dir), mode).select(
        "object_id", "quarter", "time", "flux", "flux_err", "source_file")


@register("object_stats")
def q_object_stats(spark, sf_dir):
    return round_floats(normalize.object_stats(filled_points(spark, sf_dir)))


@register("join_stats")
def q_join_stats(spark, sf_dir):
    pts = filled_points(spark, sf_dir)
    return round_floats(normalize.join_stats(pts, normalize.object_stats(pts)))


@register("zscore")
def q_zscore(spark, sf_dir):
    z = normalize.zscore(filled_points(spark, sf_dir))
    return round_floats(z.select("object_id", "quarter", "time", "flux", "flux_norm"), skip=("time", "flux"))


@register("flag_z")
def q_flag_z(spark, sf_dir):
    z = normalize.flag_z(normalize.zscore(filled_points(spark, sf_dir)), P.z_threshold)
    return round_floats(z.select("object_id", "time", "flux_norm", "is_anomaly"), skip=("time",))


@register("time_bin")
def q_time_bin(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    b = c.withColumn("bin_id", bin_id_expr("time", P.bin_width))
    return b.select("object_id", "time", "bin_id", bin_time("bin_id", P.bin_width).alias("time_bin"))


def point_trend(spark, sf_dir, strategy="auto"):
    pts = filled_points(spark, sf_dir)
    return trend.add_trend(pts, P, value="flux_norm", order=["quarter", "time", "flux"],
                           strategy=strategy, with_zscore_of="flux")


@register("rolling_median")
def q_rolling_median(spark, sf_dir):
    pts = normalize.zscore(filled_points(spark, sf_dir))
    out = trend.rolling_median(pts, P, "flux_norm", "object_id", ["quarter", "time", "flux"])
    return round_floats(out.select("object_id", "quarter", "time", "flux_norm", "rolling_median"),
                        skip=("time",))


@register("rolling_median_filled")
def q_rolling_median_filled(spark, sf_dir):
    return round_floats(point_trend(spark, sf_dir).select("object_id", "time", "rolling_flux"), skip=("time",))


@register("residual")
def q_residual(spark, sf_dir):
    return round_floats(point_trend(spark, sf_dir).select("object_id", "time", "residual"), skip=("time",))


@register("residual_outlier")
def q_residual_outlier(spark, sf_dir):
    return round_floats(point_trend(spark, sf_dir).select("object_id", "time", "residual", "residual_outlier"),
                        skip=("time",))


@register("rolling_median_blocked")
def q_rolling_median_blocked(spark, sf_dir):
    """Skew-safe strategy (ordinals + halo blocks) with small blocks so every object spans many."""
    pts = filled_points(spark, sf_dir)
    small_blocks = Params(bin_width=P.bin_width, block_rows=25)
    out = trend.add_trend(pts, small_blocks, value="flux_norm", order=["quarter", "time", "flux"],
                          strategy="blocked", with_zscore_of="flux")
    return round_floats(out.select("object_id", "time", "rolling_flux", "residual", "residual_outlier"),
                        skip=("time",))


@register("bin_anomaly")
def q_bin_anomaly(spark, sf_dir):
    out = lightcurve.process(obs(spark, sf_dir), DATASET, "bin", P)
    return out.select("object_id", "quarter", "time_bin",
                      (F.col("anomaly_count") > 0).alias("raw_flag"), "is_anomaly")


@register("bin_agg_point")
def q_bin_agg_point(spark, sf_dir):
    return q_process_point(spark, sf_dir).drop("dataset", "processing_method")


@register("bin_agg_bin")
def q_bin_agg_bin(spark, sf_dir):
    from starlit.operators.binning import bin_points_bin_mode
    z = normalize.flag_z(normalize.zscore(filled_points(spark, sf_dir, "bin")), P.z_threshold,
                         out="is_anomaly_prelim")
    return round_floats(bin_points_bin_mode(z, P.bin_width).drop("bin_id"), skip=("time_bin",))


def _canonical(spark, sf_dir, strategy):
    prep = lightcurve.prepare_observations(obs(spark, sf_dir)).select("object_id", "quarter", "time", "flux")
    placed = positions(prep, "object_id", ["quarter", "time", "flux"], strategy=strategy)
    return placed.select("object_id", "quarter", "time", (F.col("position") + 1).alias("position"))


@register("canonical_order")
def q_canonical_order(spark, sf_dir):
    return _canonical(spark, sf_dir, "auto")


@register("canonical_order_ranked")
def q_canonical_order_ranked(spark, sf_dir):
    """The same positions from range partitions, no window over a whole object."""
    return _canonical(spark, sf_dir, "ranked")


@register("prepare_observations")
def q_prepare_observations(spark, sf_dir):
    prep = lightcurve.prepare_observations(obs(spark, sf_dir))
    return round_floats(prep.select("dataset", "source_file", "object_id", "quarter", "time", "flux",
                                    "flux_err", "quality", "flux_norm", "is_anomaly"),
                        skip=("time", "flux", "quality"))


@register("prepare_by_dataset")
def q_prepare_by_dataset(spark, sf_dir):
    """Every dataset prepared by itself (own flux_err median, own object statistics), all in the same jobs."""
    prep = lightcurve.prepare_by_dataset(obs(spark, sf_dir))
    return round_floats(prep.select("dataset", "source_file", "object_id", "quarter", "time", "flux",
                                    "flux_err", "quality", "flux_norm", "is_anomaly"),
                        skip=("time", "flux", "quality"))


@register("fill_err_median_grouped")
def q_fill_err_median_grouped(spark, sf_dir):
    """Exact flux_err median of every object at once, by joint refinement with small ranges."""
    from starlit.operators.quantile import grouped_quantile
    good = clean.good_quality(cleaned(spark, sf_dir))
    medians = grouped_quantile(good, "quarter", "flux_err", buckets=64, finish_limit=50)
    table = spark.createDataFrame(sorted(medians.items()), "quarter int, median_flux_err double")
    counts = good.groupBy("quarter").agg(F.count("flux_err").alias("values"))
    return round_floats(counts.join(F.broadcast(table), "quarter"))


@register("run_summary")
def q_run_summary(spark, sf_dir):
    o = obs(spark, sf_dir)
    point = lightcurve.run_summary(o, lightcurve.process(o, DATASET, "point", P), DATASET, "point")
    binm = lightcurve.run_summary(o, lightcurve.process(o, DATASET, "bin", P), DATASET, "bin")
    return point.withColumn("mode", F.lit("point")).unionByName(binm.withColumn("mode", F.lit("bin")))


# --- extracts, sampling, dashboard --------------------------------------------------------
from starlit.operators import extract, sample  # noqa: E402


def processed(spark, sf_dir):
    """The point-mode processed series the extract steps read, materialised once in the
    shared checkpoint folder (the extract steps read it several times)."""
    from starlit.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    return lightcurve.process(obs(spark, sf_dir), DATASET, "point", P).checkpoint(eager=True)


@register("extract_project")
def q_extract_project(spark, sf_dir):
    return round_floats(extract.extract_project(processed(spark, sf_dir)), skip=("time_bin",))


@register("dashboard_extract")
def q_dashboard_extract(spark, sf_dir):
    ex = extract.dashboard_extract(processed(spark, sf_dir), max_points=2000, min_per_object=20)
    return round_floats(ex, skip=("time_bin",))


@register("downsample_by_object")
def q_downsample_by_object(spark, sf_dir):
    ds = sample.downsample_by_object(extract.extract_project(processed(spark, sf_dir)), 2000, 20)
    return ds.select("object_id", "quarter", "time_bin")


@register("even_downsample")
def q_even_downsample(spark, sf_dir):
    ds = sample.even_downsample(extract.extract_project(processed(spark, sf_dir)), 7)
    return ds.select("object_id", "quarter", "time_bin")


@register("even_downsample_ranked")
def q_even_downsample_ranked(spark, sf_dir):
    """Even downsample by positions over range partitions."""
    ds = sample.even_downsample(extract.extract_project(processed(spark, sf_dir)), 7, strategy="ranked")
    return ds.select("object_id", "quarter", "time_bin")


@register("random_downsample")
def q_random_downsample(spark, sf_dir):
    ds = sample.random_downsample(extract.extract_project(processed(spark, sf_dir)), 7)
    return ds.select("object_id", "quarter", "time_bin")


@register("extract_metadata")
def q_extract_metadata(spark, sf_dir):
    before = extract.extract_project(processed(spark, sf_dir))
    ex = sample.downsample_by_object(before, 2000, 20)
    meta = extract.extract_metadata(before, ex, DATASET, "spark")
    return meta.select("dataset", "processing_method", "visualization_method", "visualization_type",
                       "rows_before_downsample", "rows_saved_for_dashboard", "anomaly_rows",
                       "min_time", "max_time", "n_objects", "object_preview", "quarters")


@register("object_series")
def q_object_series(spark, sf_dir):
    ex = extract.extract_project(processed(spark, sf_dir))
    first = extract.object_list(ex).filter(F.col("is_default")).select("object_id")
    return round_floats(ex.join(first, "object_id", "left_semi"), skip=("time_bin",))


@register("time_range_subset")
def q_time_range_subset(spark, sf_dir):
    ex = extract.extract_project(processed(spark, sf_dir))
    return extract.time_range(ex, 5.0, 20.0).select("object_id", "quarter", "time_bin")


@register("anomaly_points")
def q_anomaly_points(spark, sf_dir):
    ex = extract.extract_project(processed(spark, sf_dir))
    return round_floats(ex.filter(F.col("is_anomaly")).select("object_id", "time_bin", "flux_norm"),
                        skip=("time_bin",))


@register("time_extent")
def q_time_extent(spark, sf_dir):
    return round_floats(extract.time_extent(extract.extract_project(processed(spark, sf_dir))))


@register("object_list")
def q_object_list(spark, sf_dir):
    return extract.object_list(extract.extract_project(processed(spark, sf_dir)))


@register("object_preview")
def q_object_preview(spark, sf_dir):
    return extract.object_preview(extract.extract_project(processed(spark, sf_dir)))


@register("quarters_text")
def q_quarters_text(spark, sf_dir):
    ex = extract.extract_project(processed(spark, sf_dir))
    return ex.groupBy("object_id").agg(extract.quarters_text(F.col("quarter")).alias("quarters"))


@register("top_object")
def q_top_object(spark, sf_dir):
    return extract.top_object(processed(spark, sf_dir))


@register("chart_series")
def q_chart_series(spark, sf_dir):
    return round_floats(extract.chart_series(processed(spark, sf_dir), 20), skip=("x",))


@register("chart_series_ranked")
def q_chart_series_ranked(spark, sf_dir):
    return round_floats(extract.chart_series(processed(spark, sf_dir), 20, strategy="ranked"), skip=("x",))


def written_extract(spark, sf_dir):
    """The dashboard's extract as the dashboard reads it: written clustered by object and time."""
    import uuid
    from starlit.session import scratch_path
    path = scratch_path(spark, f"extract/{uuid.uuid4().hex}")
    extract.write_extract(extract.extract_project(lightcurve.process(obs(spark, sf_dir), DATASET, "point", P)), path)
    return spark.read.parquet(path)


def _refresh(spark, sf_dir):
    """One dashboard refresh for the default object, days 3 to 27, at most 25 points."""
    return extract.dashboard_query(written_extract(spark, sf_dir), None, 3.0, 27.0, 25)


@register("dashboard_query")
def q_dashboard_query(spark, sf_dir):
    """One dashboard refresh for the default object over its whole time range (limit 5,000 points)."""
    plotted, _, _ = extract.dashboard_query(written_extract(spark, sf_dir), None, None, None, 5000)
    return round_floats(plotted.select("object_id", "quarter", "time_bin", "flux_norm", "rolling_flux",
                                      "is_anomaly"), skip=("time_bin",))


@register("dashboard_plotted")
def q_dashboard_plotted(spark, sf_dir):
    return round_floats(_refresh(spark, sf_dir)[0].select("object_id", "quarter", "time_bin", "flux_norm", "is_anomaly"), skip=("time_bin",))


@register("dashboard_anomalies")
def q_dashboard_anomalies(spark, sf_dir):
    """Anomalies of a refresh, of the object with the most of them (default limit)."""
    ex = written_extract(spark, sf_dir)
    per = ex.groupBy("object_id").agg(F.count_if("is_anomaly").alias("n"))
    most = per.select(F.max_by("object_id", F.struct("n", "object_id"))).scalar()
    anomalies = extract.dashboard_query(ex, most)[1]
    return round_floats(anomalies.select("object_id", "quarter", "time_bin", "flux_norm"), skip=("time_bin",))


@register("dashboard_refresh_summary")
def q_dashboard_refresh_summary(spark, sf_dir):
    return round_floats(_refresh(spark, sf_dir)[2])


@register("dashboard_summary_table")
def q_dashboard_summary_table(spark, sf_dir):
    ex = extract.extract_project(processed(spark, sf_dir))
    return extract.dashboard_summary_table(extract.dashboard_summary(ex, max_points=5000), DATASET)


@register("dashboard_summary")
def q_dashboard_summary(spark, sf_dir):
    """Summaries of all rows of all objects."""
    ex = extract.extract_project(processed(spark, sf_dir))
    return round_floats(extract.dashboard_summary(ex, max_points=None))


# --- run logs and analytics ------------------------------------------------------------------
from starlit.operators import analysis, runlog  # noqa: E402


def metrics(spark, sf_dir):
    return adapters.run_metrics(spark, sf_dir)


def clean_log(spark, sf_dir):
    return runlog.clean_run_log(metrics(spark, sf_dir))


def partials(spark, sf_dir):
    return analysis.run_partials(clean_log(spark, sf_dir))


@register("split_pair")
def q_split_pair(spark, sf_dir):
    m = metrics(spark, sf_dir)
    q = (F.col("processing_memory_peak_mb").cast("long") % 4)
    variant = (F.when(q == 0, F.col("pair"))
               .when(q == 1, F.concat(F.col("pair"), F.lit(" +x")))
               .when(q == 2, F.lit(None).cast("string"))
               .otherwise(F.concat(F.upper(F.col("pair")), F.lit(" +"))))
    from starlit.functions.expr import split_pair
    proc, viz = split_pair(variant)
    return m.select(variant.alias("pair"), proc.alias("processing_method"), viz.alias("visualization_method"))


@register("successful_runs")
def q_successful_runs(spark, sf_dir):
    return runlog.successful_runs(metrics(spark, sf_dir))


@register("clean_run_log")
def q_clean_run_log(spark, sf_dir):
    return clean_log(spark, sf_dir)


@register("custom_order")
def q_custom_order(spark, sf_dir):
    return runlog.with_order(clean_log(spark, sf_dir)).select(
        "dataset", "pair", "total_time_sec", "dataset_order", "method_order", "viz_order")


@register("best_pair_by_dataset")
def q_best_pair_by_dataset(spark, sf_dir):
    return analysis.best_pair_by_dataset(clean_log(spark, sf_dir))


@register("best_pair_by_method")
def q_best_pair_by_method(spark, sf_dir):
    return analysis.best_pair_by_method(clean_log(spark, sf_dir))


@register("processing_summary")
def q_processing_summary(spark, sf_dir):
    return round_floats(analysis.processing_summary(clean_log(spark, sf_dir)))


@register("visualization_summary")
def q_visualization_summary(spark, sf_dir):
    return round_floats(analysis.visualization_summary(clean_log(spark, sf_dir)))


@register("pair_ranking")
def q_pair_ranking(spark, sf_dir):
    return round_floats(analysis.pair_ranking(clean_log(spark, sf_dir)))


@register("fastest_method")
def q_fastest_method(spark, sf_dir):
    return round_floats(analysis.fastest_method(clean_log(spark, sf_dir)))


@register("avg_total_by_method")
def q_avg_total_by_method(spark, sf_dir):
    return round_floats(analysis.mean_by(clean_log(spark, sf_dir), "processing_method", "total_time_sec",
                                         "mean_total_time_sec"))


@register("avg_memory_by_method")
def q_avg_memory_by_method(spark, sf_dir):
    return round_floats(analysis.mean_by(clean_log(spark, sf_dir), "processing_method",
                                         "processing_memory_peak_mb", "mean_memory_peak_mb"))


@register("avg_viz_by_method")
def q_avg_viz_by_method(spark, sf_dir):
    return round_floats(analysis.mean_by(clean_log(spark, sf_dir), "visualization_method",
                                         "visualization_time_sec", "mean_visualization_time_sec"))


@register("chart_labels")
def q_chart_labels(spark, sf_dir):
    return analysis.chart_labels(clean_log(spark, sf_dir)).select("dataset", "pair", "total_time_sec", "label")


@register("report_lines")
def q_report_lines(spark, sf_dir):
    return round_floats(analysis.report_lines(partials(spark, sf_dir)))


@register("format_metrics")
def q_format_metrics(spark, sf_dir):
    return round_floats(analysis.format_report(analysis.report_lines(partials(spark, sf_dir))))


@register("mode_method")
def q_mode_method(spark, sf_dir):
    from starlit.operators.extract import mode_value
    return runlog.with_methods(metrics(spark, sf_dir)).groupBy("dataset").agg(
        mode_value(F.col("processing_method")).alias("processing_method"))


def three_logs(spark, sf_dir):
    m = runlog.with_methods(metrics(spark, sf_dir))
    first = m.filter(F.col("processing_method").isin("m1", "m2"))
    second = m.filter(F.col("processing_method").isin("m3", "m4")).drop("processing_memory_peak_mb")
    third = m.filter(~F.col("processing_method").isin("m1", "m2", "m3", "m4")).drop("visualization_time_sec")
    return [first, second, third]


@register("combine_run_logs")
def q_combine_run_logs(spark, sf_dir):
    return runlog.combine_run_logs(three_logs(spark, sf_dir))


def processing_runs(spark, sf_dir):
    li = adapters.table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("dataset"),
                      F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("processing_method")).agg(
        (F.max("l_linenumber") != 6).alias("input_exists"),
        round_scaled(F.sum("l_extendedprice") / F.lit(1.0e7), 6).alias("processing_time_sec"),
        F.max("l_quantity").alias("processing_memory_peak_mb"),
        F.when(F.max("l_linenumber") == 7, F.lit("error")).otherwise(F.lit("success")).alias("status"),
        F.when(F.max("l_linenumber") == 7, F.lit("processing failed")).alias("error"),
        F.lit("in.parquet").alias("input_file"), F.lit("out.parquet").alias("output_file"),
        F.count(F.lit(1)).alias("rows_input"), F.count_if(F.col("l_tax") < 0.07).alias("rows_after_cleaning"),
        F.count_if(F.col("l_tax") < 0.05).alias("rows_output"), F.count_distinct("l_suppkey").alias("objects"),
        F.count_distinct(F.quarter("l_shipdate")).alias("quarters"), F.count_if(F.col("l_discount") > 0.09).alias("anomaly_rows"),
    )


def visualization_runs(spark, sf_dir):
    li = adapters.table(spark, sf_dir, "lineitem")
    vizs = F.array(F.lit("matplotlib"), F.lit("plotly"), F.lit("dash"))
    return li.groupBy(F.col("l_returnflag").alias("dataset"),
                      F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("processing_method"),
                      F.element_at(vizs, (F.col("l_suppkey") % 3).cast("int") + 1).alias("visualization_method")
                      ).agg(
        round_scaled(F.avg("l_discount"), 6).alias("visualization_time_sec"),
        F.max("l_tax").alias("visualization_memory_peak_mb"),
        F.when(F.min("l_quantity") <= 1.0, F.lit("error")).otherwise(F.lit("success")).alias("status"),
        F.when(F.min("l_quantity") <= 1.0, F.lit("visualization failed")).alias("error"),
    )


def chart_runs(spark, sf_dir):
    """What each visualisation plotted; there is no metadata of the static charts of return flag N."""
    li = adapters.table(spark, sf_dir, "lineitem")
    vizs = F.array(F.lit("matplotlib"), F.lit("plotly"), F.lit("dash"))
    runs = li.groupBy(F.col("l_returnflag").alias("dataset"),
                      F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("processing_method"),
                      F.element_at(vizs, (F.col("l_suppkey") % 3).cast("int") + 1).alias("visualization_method")).agg(
        F.count_if(F.col("l_quantity") > 10).alias("points_plotted"),
        F.count_if(F.col("l_quantity") > 45).alias("anomaly_points_plotted"), F.count(F.lit(1)).alias("rows"))
    dash = F.col("visualization_method") == "dash"
    return runs.filter((F.col("dataset") != "N") | (F.col("visualization_method") != "matplotlib")).select(
        "dataset", "processing_method", "visualization_method", "points_plotted", "anomaly_points_plotted",
        F.concat(F.col("visualization_method"), F.lit(".out")).alias("visualization_file"),
        F.when(dash, F.lit("meta.json")).alias("visualization_metadata_file"),
        F.when(dash, F.lit("interactive_web_dashboard")).otherwise(F.lit("chart")).alias("visualization_type"),
        F.when(dash, F.col("rows")).alias("rows_before_downsample"))


@register("assemble_run_log")
def q_assemble_run_log(spark, sf_dir):
    """All columns; counts as doubles, as a table with missing counts has them when read back from CSV."""
    log = runlog.assemble_run_log(processing_runs(spark, sf_dir), visualization_runs(spark, sf_dir), chart_runs(spark, sf_dir))
    return round_floats(log.select(*[F.col(f.name).cast("double") if isinstance(f.dataType, T.LongType) else f.name for f in log.schema.fields]))


@register("chart_metadata")
def q_chart_metadata(spark, sf_dir):
    """Chart metadata of the chart of the most observed object (limit 20 points)."""
    points = extract.chart_points(processed(spark, sf_dir), 20)
    return extract.chart_metadata(points, DATASET, "spark", "plotly", "interactive_html", "chart.html").drop("rows_before_downsample")


@register("scan_run_metrics")
def q_scan_run_metrics(spark, sf_dir):
    import uuid
    from starlit.session import scratch_path
    path = scratch_path(spark, f"run_metrics_csv/{uuid.uuid4().hex}")
    metrics(spark, sf_dir).write.option("header", True).csv(path)
    df = runlog.read_run_metrics_csv(spark, path)
    return df.withColumns({c: F.col(c).try_cast("double") for c in runlog.METRIC_NUMBERS})


# --- ephemeris ---------------------------------------------------------------------------------------
from starlit.operators import ephemeris as eph  # noqa: E402


def obs_with_ephemeris(spark, sf_dir):
    return eph.join_ephemeris(cleaned(spark, sf_dir), adapters.ephemeris(spark, sf_dir))


@register("join_ephemeris")
def q_join_ephemeris(spark, sf_dir):
    return obs_with_ephemeris(spark, sf_dir).select("object_id", "time", "flux", "period", "depth", "duration",
                                                    "base_flux")


@register("phase_fold")
def q_phase_fold(spark, sf_dir):
    return round_floats(eph.fold(obs_with_ephemeris(spark, sf_dir)).select("object_id", "time", "phase"),
                        skip=("time",))


@register("transit_flag")
def q_transit_flag(spark, sf_dir):
    return eph.fold(obs_with_ephemeris(spark, sf_dir)).select("object_id", "time", "in_transit")


@register("model_residual")
def q_model_residual(spark, sf_dir):
    out = eph.fold(obs_with_ephemeris(spark, sf_dir))
    return round_floats(out.select("object_id", "time", "model_flux", "model_residual"), skip=("time",))


@register("quarter_from_time")
def q_quarter_from_time(spark, sf_dir):
    c = cleaned(spark, sf_dir).withColumn("t", F.col("time") * F.lit(30.0))
    return c.select("object_id", "t", eph.quarter_from_time("t").alias("quarter"))


# --- sources and sinks ------------------------------------------------------------------------------------
from starlit.sources import fits, tables  # noqa: E402


FILES_BATCH_BYTES = 16 << 20


def _encode_file(dataset, object_id, quarter, time, flux, err, qual_int):
    """One observation group (dataset, object, quarter) -> (path, bytes) of one light-curve file, varied by object."""
    from starlit.plans.light_curve_writer import encode_light_curve

    u, quarter = int(object_id), int(quarter)
    variant = u % 4
    name = f"kplr{u:09d}-q{quarter}_llc.fits"
    primary, table = {}, {"TNULL4": -999}
    if variant == 0:
        cols = {"TIME": time, "PDCSAP_FLUX": flux, "PDCSAP_FLUX_ERR": err, "SAP_QUALITY": qual_int}
        primary = {"KEPLERID": u, "QUARTER": quarter}
    elif variant == 1:
        cols = {"time": time, "pdcsap_flux": flux, "pdcsap_flux_err": err, "sap_quality": qual_int}
        table.update({"KEPLERID": u, "QUARTER": quarter})
    elif variant == 2:
        cols = {"TIME": time, "SAP_FLUX": flux, "SAP_FLUX_ERR": err, "QUALITY": qual_int}
        primary = {"KEPLERID": u, "QUARTER": 0}
    else:
        cols = {"TIME": time, "SAP_FLUX": flux}
        primary = {"QUARTER": quarter}
        table = {}
    forms = {c: ("J" if c.upper().endswith("QUALITY") else "D") for c in cols}
    content = encode_light_curve(cols, forms, primary, table)
    if u % 10 == 5 and quarter == 3:
        content = content[:3000]          # truncated file
    return f"derived/{dataset}/{name}", content


def _key_runs(batches):
    """Rows in key order -> (dataset, object_id, quarter, four arrays) of each run of equal keys, however many batches
    it spans. Only the run at a batch's end is carried over, in pieces that are joined once."""
    import numpy as np

    key, pieces = None, []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("dataset", "object_id", "quarter")]
        values = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("time", "flux", "flux_err")]
        quality = batch.column("quality").to_numpy(zero_copy_only=False)
        values.append(np.where(np.isnan(quality), -999, quality).astype("int32"))
        new = np.zeros(n, dtype=bool)
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(new)
        for a, b in zip(starts, [*starts[1:], n]):
            here, piece = tuple(k[a] for k in keys), [v[a:b] for v in values]
            if here != key and pieces:
                yield *key, [np.concatenate(v) for v in zip(*pieces)] if len(pieces) > 1 else pieces[0]
                pieces = []
            key = here
            pieces.append(piece)
    if pieces:
        yield *key, [np.concatenate(v) for v in zip(*pieces)] if len(pieces) > 1 else pieces[0]


def _encode_files(batches):
    """Observations in (dataset, object, quarter, time) order -> one light-curve file per group."""
    import pyarrow as pa

    def batch(files):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*files), (pa.string(), pa.binary(), pa.string()))],
                                          names=["path", "content", "dataset"])

    files, held = [], 0
    for dataset, object_id, quarter, values in _key_runs(batches):
        path, content = _encode_file(dataset, object_id, quarter, *values)
        files.append((path, content, dataset))
        held += len(content)
        if held >= FILES_BATCH_BYTES:
            yield batch(files)
            files, held = [], 0
    if files:
        yield batch(files)


def light_curve_files(spark, sf_dir):
    """One encoded light-curve file per (dataset, object, quarter) of the obs adapter."""
    key = ["dataset", "object_id", "quarter"]
    o = obs(spark, sf_dir).select(*key, "time", "flux", "flux_err", "quality")
    return o.repartition(*key).sortWithinPartitions(*key, F.asc_nulls_last("time")).mapInArrow(
        _encode_files, "path string, content binary, dataset string")


def ingested(spark, sf_dir):
    return fits.parse_light_curves(light_curve_files(spark, sf_dir))


@register("ingest_light_curves")
def q_ingest_light_curves(spark, sf_dir):
    return fits.good_rows(ingested(spark, sf_dir))


@register("ingest_errors")
def q_ingest_errors(spark, sf_dir):
    return fits.error_rows(ingested(spark, sf_dir)).select("dataset", "file")


@register("header_fallback")
def q_header_fallback(spark, sf_dir):
    return fits.good_rows(ingested(spark, sf_dir)).select("source_file", "object_id", "quarter").distinct()


@register("file_inventory")
def q_file_inventory(spark, sf_dir):
    files = light_curve_files(spark, sf_dir).drop("content")
    return fits.file_inventory(spark, files, ["small", "medium", "large", "empty"])


@register("resolve_columns")
def q_resolve_columns(spark, sf_dir):
    o = obs(spark, sf_dir).select("dataset", "object_id", "quarter", F.col("time").alias("TIME"),
                                  F.col("flux").alias("sap_flux"), F.col("flux_err").alias("Sap_Flux_Err"),
                                  F.col("quality").alias("QUALITY"))
    return tables.to_observations(o)


@register("conversion_summary")
def q_conversion_summary(spark, sf_dir):
    from starlit.plans.convert import conversion_summary
    from starlit.sources.scratch import written
    parsed = written(ingested(spark, sf_dir), "ingested")  # read by every step of the summary, decoded once
    files = light_curve_files(spark, sf_dir).drop("content")
    return conversion_summary(spark, parsed, files, ["small", "medium", "large", "empty"]).drop("size_mb", "output_file")


@register("preview_head")
def q_preview_head(spark, sf_dir):
    prep = lightcurve.prepare_observations(obs(spark, sf_dir))
    return round_floats(tables.preview_head(prep, 5000).select("object_id", "quarter", "time", "flux", "flux_norm"),
                        skip=("time", "flux"))


@register("union_parts")
def q_union_parts(spark, sf_dir):
    from starlit.operators.runlog import combine_run_logs
    o = obs(spark, sf_dir)
    parts = [o.filter(F.col("dataset") == d) for d in adapters.DATASET_NAMES]
    return combine_run_logs(parts)


@register("sink_parquet")
def q_sink_parquet(spark, sf_dir):
    import uuid
    from starlit.session import scratch_path
    path = scratch_path(spark, f"prepared/{uuid.uuid4().hex}")
    prep = lightcurve.prepare_observations(obs(spark, sf_dir))
    tables.write_parquet(prep, path, compression="zstd", partition_by="dataset")
    return spark.read.parquet(path).select("dataset", "object_id", "quarter", "time", "flux")


@register("discover_extracts")
def q_discover_extracts(spark, sf_dir):
    import uuid
    from starlit.operators import extract
    from starlit.session import scratch_path
    base = scratch_path(spark, f"dash_data/{uuid.uuid4().hex}")
    o = obs(spark, sf_dir)
    for mode in ("point", "bin"):
        ex = extract.extract_project(lightcurve.process(o, DATASET, mode, P, method=f"spark-{mode}"))
        tables.write_parquet(ex, f"{base}/{DATASET}_{mode}_dash_data.parquet")
    found = tables.discover_extracts(spark, base)
    return found.groupBy("dataset_key").agg(F.count(F.lit(1)).alias("rows"))


# --- one object holding a third of all rows ------------------------------------------------------------
SKEW_PARAMS = Params(bin_width=0.5, hot_object_rows=1000, block_rows=500)


def skewed_obs(spark, sf_dir):
    """obs with every object whose id is divisible by 3 merged into object '0' (a third of all rows)."""
    from starlit.functions.expr import with_sql
    return with_sql(obs(spark, sf_dir),
                    {"object_id": "CASE WHEN CAST(object_id AS INT) % 3 = 0 THEN '0' ELSE object_id END"})


@register("process_point_skewed")
def q_process_point_skewed(spark, sf_dir):
    """Point mode with one hot object: it takes the blocked (ordinal + halo) trend path."""
    out = lightcurve.process(skewed_obs(spark, sf_dir), DATASET, "point", SKEW_PARAMS)
    return round_floats(out, skip=("time_bin",))


@register("process_bin_skewed")
def q_process_bin_skewed(spark, sf_dir):
    """Bin mode with one hot object: z-score by aggregate + join (AQE), bins and bin trend after."""
    out = lightcurve.process(skewed_obs(spark, sf_dir), DATASET, "bin", SKEW_PARAMS)
    return round_floats(out, skip=("time_bin",))


# --- the large-input trend path (vectorised per-partition pass), forced on the test tables ---------
VECTOR_PARAMS = Params(bin_width=0.5, vectorize_rows=0)


@register("process_point_vectorized")
def q_process_point_vectorized(spark, sf_dir):
    out = lightcurve.process(obs(spark, sf_dir), DATASET, "point", VECTOR_PARAMS)
    return round_floats(out, skip=("time_bin",))


@register("process_bin_vectorized")
def q_process_bin_vectorized(spark, sf_dir):
    out = lightcurve.process(obs(spark, sf_dir), DATASET, "bin", VECTOR_PARAMS)
    return round_floats(out, skip=("time_bin",))


# --- constant series and infinite values: every strategy must give the same answer ----------------
def flat_obs(spark, sf_dir):
    """obs with constant flux in every object whose id is divisible by 5 and infinite flux in quarter 2 of
    those whose id leaves 3 modulo 7."""
    from starlit.functions.expr import with_sql
    return with_sql(obs(spark, sf_dir), {
        "flux": "CASE WHEN flux IS NULL THEN flux WHEN CAST(object_id AS INT) % 5 = 0 THEN 1234.7D "
                "WHEN CAST(object_id AS INT) % 7 = 3 AND quarter = 2 THEN double('Infinity') ELSE flux END"})


def _flat(mode, strategy):
    def run(spark, sf_dir):
        out = lightcurve.process(flat_obs(spark, sf_dir), DATASET, mode, Params(bin_width=0.5, block_rows=60), strategy=strategy)
        return round_floats(out, skip=("time_bin",))
    run.__doc__ = f"{mode} mode with constant and infinite series, trend strategy {strategy}."
    return run


for _mode in ("point", "bin"):
    for _strategy in ("window", "vectorized", "blocked"):
        register(f"process_{_mode}_flat_{_strategy}")(_flat(_mode, _strategy))

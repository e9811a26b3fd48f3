"""End-to-end light-curve pipelines, each one lazy DataFrame plan.

``process(df, dataset, mode="point")`` - per-point trend and flags, then bins.
``process(df, dataset, mode="bin")``   - bins first (z flags counted per bin),
                                          then trend and flags on the bins.
The two modes give different anomaly answers by design; both are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from starlit.operators.binning import bin_points_bin_mode, bin_points_point_mode
from starlit.operators.clean import clean_observations, drop_invalid, fill_flux_err, good_quality, \
    coerce_numeric, with_defaults, normalize_keys, profile
from starlit.operators.normalize import flag_z, zscore
from starlit.operators.quantile import finite_facts, grouped_quantile
from starlit.operators.trend import add_trend
from starlit.schema import Params

# The output columns of both modes, in order.
POINT_COLUMNS = ["object_id", "quarter", "time_bin", "flux_norm", "rolling_flux", "flux_err",
                 "points_count", "anomaly_count", "source_files", "is_anomaly", "dataset",
                 "processing_method"]
BIN_COLUMNS = ["object_id", "quarter", "time_bin", "flux_norm", "flux_err", "points_count",
               "anomaly_count", "source_files", "dataset", "processing_method", "rolling_flux",
               "residual", "is_anomaly"]


def prepare_observations(df: DataFrame, z_threshold: float = Params().z_threshold,
                         hot_object_rows: int = Params().hot_object_rows) -> DataFrame:
    """Ingest-time preparation: coerce, drop rows without time/flux, fill flux_err with the
    median (0 when all missing), fill quality, per-object z-score (no quality filter), z flag."""
    df = with_defaults(df)
    df = drop_invalid(normalize_keys(coerce_numeric(df)), ("time", "flux"))
    df = df.withColumn("quality", F.coalesce(F.col("quality"), F.lit(0.0)))
    prof = profile(df)
    df = fill_flux_err(df, "median_or_zero", count=prof["all_err_count"], value_range=prof["all_err_range"])
    small = prof["all_max_object_rows"] <= hot_object_rows
    df = zscore(df, "flux", "flux_norm", strategy="window" if small else "join")
    return flag_z(df, z_threshold)


def prepare_by_dataset(df: DataFrame, z_threshold: float = Params().z_threshold,
                       hot_object_rows: int = Params().hot_object_rows) -> DataFrame:
    """``prepare_observations`` of every dataset in ``df`` by itself, all of them in the same jobs: one profile (per
    dataset and object, then per dataset) and one refinement of the medians, however many datasets there are."""
    df = drop_invalid(normalize_keys(coerce_numeric(with_defaults(df))), ("time", "flux"))
    df = df.withColumn("quality", F.coalesce(F.col("quality"), F.lit(0.0)))
    facts = finite_facts("flux_err")
    per = df.groupBy("dataset", "object_id").agg(F.count(F.lit(1)).alias("rows"), *[a.alias(c) for c, a in facts.items()])
    found = per.groupBy("dataset").agg(F.max("rows").alias("most"), F.sum("n").alias("n"), F.sum("below").alias("below"),
                                       F.sum("above").alias("above"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    medians = grouped_quantile(df, "dataset", "flux_err", known={r["dataset"]: tuple(r[c] for c in facts) for r in found})
    fill = df.sparkSession.createDataFrame([(d, 0.0 if m is None else m) for d, m in medians.items()], "d string, fill double")
    df = df.join(F.broadcast(fill), F.col("dataset").eqNullSafe(F.col("d")), "left").withColumn(  # one row per dataset
        "flux_err", F.coalesce("flux_err", "fill")).drop("d", "fill")
    small = max((r["most"] for r in found), default=0) <= hot_object_rows
    keyed = df.withColumn("_series", F.struct("dataset", "object_id"))
    return flag_z(zscore(keyed, "flux", "flux_norm", key="_series", strategy="window" if small else "join").drop("_series"), z_threshold)


def cleaned_points(df: DataFrame, mode: str) -> DataFrame:
    """Shared head of both modes: clean, good-quality filter with fallback, flux_err fill."""
    return profiled_points(df, mode)[0]


def profiled_points(df: DataFrame, mode: str):
    """(cleaned points, profile): one profile job decides the quality fallback, gives the
    flux_err mean and the largest object size; point mode adds one exact-median job."""
    c = clean_observations(df)
    prof = profile(c)
    good = good_quality(c, prof["any_ok"])
    if mode == "point":
        return fill_flux_err(good, "median", count=prof["err_count"], value_range=prof["err_range"]), prof
    return fill_flux_err(good, "mean", count=prof["err_count"], mean=prof["err_mean"]), prof


def process(df: DataFrame, dataset: str, mode: str = "point", params: Params = Params(),
            method: str = "spark", strategy: str = "auto", profile_out: dict | None = None) -> DataFrame:
    """Run one mode; ``profile_out`` (a dict) receives the profile facts (e.g. rows after cleaning)."""
    if mode == "point":
        return process_point(df, dataset, params, method, strategy, profile_out)
    if mode == "bin":
        return process_bin(df, dataset, params, method, strategy, profile_out)
    raise ValueError(f"unknown mode: {mode}")


def process_point(df: DataFrame, dataset: str, params: Params = Params(), method: str = "spark",
                  strategy: str = "auto", profile_out: dict | None = None) -> DataFrame:
    pts, prof = profiled_points(df, "point")
    if profile_out is not None:
        profile_out.update(prof)
    pts = pts.select("object_id", "quarter", "time", "flux", "flux_err", "source_file")
    trended = add_trend(pts, params, value="flux_norm", order=["quarter", "time", "flux"],
                        strategy=strategy, with_zscore_of="flux", max_rows=prof["max_object_rows"],
                        total_rows=prof["rows"])
    flagged = trended.withColumn("is_anomaly", F.col("residual_outlier"))
    bins = bin_points_point_mode(flagged, params.bin_width)
    return bins.withColumns({"dataset": F.lit(dataset), "processing_method": F.lit(method)}) \
        .select(*POINT_COLUMNS)


def process_bin(df: DataFrame, dataset: str, params: Params = Params(), method: str = "spark",
                strategy: str = "auto", profile_out: dict | None = None) -> DataFrame:
    pts, prof = profiled_points(df, "bin")
    if profile_out is not None:
        profile_out.update(prof)
    pts = pts.select("object_id", "quarter", "time", "flux", "flux_err", "source_file")
    # No object can be hot: a per-object window for the z-score clusters the points by
    # object once, and the bin aggregate and bin windows reuse that partitioning (one
    # exchange).  Otherwise aggregate + join (AQE broadcasts or skew-splits it).
    small = strategy == "window" or (strategy == "auto" and prof["max_object_rows"] <= params.hot_object_rows)
    z = zscore(pts, "flux", "flux_norm", strategy="window" if small else "join")
    z = flag_z(z, params.z_threshold, out="is_anomaly_prelim")
    bins = bin_points_bin_mode(z, params.bin_width)
    # an object has no more bins than rows, so the row profile bounds the bin count too
    trended = add_trend(bins, params, value="flux_norm", order=["quarter", "bin_id"], strategy=strategy,
                        max_rows=prof["max_object_rows"], total_rows=prof["rows"])
    out = trended.withColumn("is_anomaly", F.col("residual_outlier") | (F.coalesce(F.col("anomaly_count"), F.lit(0)) > 0))
    return out.withColumns({"dataset": F.lit(dataset), "processing_method": F.lit(method)}) \
        .select(*BIN_COLUMNS)


def run_summary(raw: DataFrame, processed: DataFrame, dataset: str, mode: str = "point") -> DataFrame:
    """One-row summary: rows_input, rows_after_cleaning, rows_output, objects, quarters, anomaly_rows."""
    rows_input = raw.select(F.count(F.lit(1))).scalar()
    rows_clean = cleaned_points(raw, mode).select(F.count(F.lit(1))).scalar()
    agg = processed.agg(
        F.count(F.lit(1)).alias("rows_output"),
        F.count_distinct("object_id").alias("objects"),
        F.count_distinct("quarter").alias("quarters"),
        F.sum(F.col("is_anomaly").cast("long")).alias("anomaly_rows"),
    )
    return agg.select(
        F.lit(dataset).alias("dataset"),
        rows_input.alias("rows_input"),
        rows_clean.alias("rows_after_cleaning"),
        "rows_output", "objects", "quarters",
        F.coalesce(F.col("anomaly_rows"), F.lit(0)).cast("long").alias("anomaly_rows"),
    )


def observed_counts(df: DataFrame, name: str = "rows"):
    """Attach a row counter filled by the first job that reads ``df`` (no extra pass)."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs


def output_summary(processed: DataFrame, dataset: str, rows_input: int, rows_after_cleaning: int) -> dict:
    """Summary of a written output: one small aggregate over the output plus known counts."""
    agg = processed.agg(
        F.count(F.lit(1)).alias("rows_output"), F.count_distinct("object_id").alias("objects"),
        F.count_distinct("quarter").alias("quarters"),
        F.coalesce(F.sum(F.col("is_anomaly").cast("long")), F.lit(0)).alias("anomaly_rows")).first()
    return {"dataset": dataset, "rows_input": int(rows_input), "rows_after_cleaning": int(rows_after_cleaning),
            **agg.asDict()}

"""Time bins and per-bin aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlit.functions.expr import q, with_sql

BIN_KEYS = ["object_id", "quarter", "bin_id"]


def with_time_bin(df: DataFrame, width: float, time: str = "time", keep_time_bin: bool = False) -> DataFrame:
    """bin_id = floor(time / width) (bigint group key); time_bin = bin_id * width on request."""
    cols = {"bin_id": f"FLOOR({q(time)} / {float(width)!r}D)"}
    if keep_time_bin:
        cols["time_bin"] = f"FLOOR({q(time)} / {float(width)!r}D) * {float(width)!r}D"
    return with_sql(df, cols)


def _finish(df: DataFrame, width: float, flag: bool) -> DataFrame:
    cols = {"time_bin": f"bin_id * {float(width)!r}D"}
    if flag:
        cols["is_anomaly"] = "anomaly_count > 0"
    return with_sql(df, cols)


# Distinct source files of one bin: a bin holds the points of one object in one
# quarter, so the set is bounded by the files covering that bin; a set aggregate
# keeps the whole aggregation to one exchange (countDistinct would expand every
# row and add a second one).
DISTINCT_SOURCES = "CAST(size(collect_set(source_file)) AS BIGINT) AS source_files"


def bin_points_point_mode(df: DataFrame, width: float) -> DataFrame:
    """Point-level variant: means of flux_norm, rolling_flux, flux_err; row count; anomaly count."""
    b = with_time_bin(df, width)
    agg = b.groupBy(*BIN_KEYS).agg(*[F.expr(e) for e in (
        "avg(flux_norm) AS flux_norm", "avg(rolling_flux) AS rolling_flux", "avg(flux_err) AS flux_err",
        "count(1) AS points_count", "sum(CAST(is_anomaly AS BIGINT)) AS anomaly_count", DISTINCT_SOURCES)])
    return _finish(agg, width, flag=True)


def bin_points_bin_mode(df: DataFrame, width: float) -> DataFrame:
    """Bin-level variant: means of flux_norm and flux_err; count(flux); count of |z| flags."""
    b = with_time_bin(df, width)
    agg = b.groupBy(*BIN_KEYS).agg(*[F.expr(e) for e in (
        "avg(flux_norm) AS flux_norm", "avg(flux_err) AS flux_err", "count(flux) AS points_count",
        "sum(CAST(is_anomaly_prelim AS BIGINT)) AS anomaly_count", DISTINCT_SOURCES)])
    return _finish(agg, width, flag=False)
